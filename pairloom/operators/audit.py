"""Audits of judges and rankings: calibration by rater, spin, consortium, nuisance, draws, slates, designs, stops.

Functions take and return DataFrames; each states its columns.  Groups without
the readings that a measure needs have nulls there, never errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.ordered import positions

TINY = 1e-18
#: Weights are counted in millionths for the weighted median.
UNIT = 1e6
#: Half width of a 95 % interval in standard errors.
Z95 = 1.96


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """(keys, median): the least value up to which half of the weight lies; one distributed sort."""
    n = F.round(F.col(weight) * UNIT).cast("long")
    counts = rows.groupBy(*keys, F.col(value).alias("_v")).agg(F.sum(n).alias("n")).filter("n > 0")
    placed = positions(counts, keys, ["_v"])
    return placed.filter((F.col("before") + F.col("n")) * 2 >= F.col("total")).groupBy(*keys).agg(F.min("_v").alias("median"))


def mad(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mad): 1.4826 times the median distance from the median."""
    middle = rows.groupBy(*keys).agg(F.median(value).alias("_m"))
    return rows.join(middle, keys).groupBy(*keys).agg((F.median(F.abs(F.col(value) - F.col("_m"))) * 1.4826).alias("mad"))


def rater_calibration(edges: DataFrame, contributors: DataFrame, keys: list[str], rater: str) -> DataFrame:
    """(keys, rater, edges, efficacy, bias, scatter) from edges (keys, i, j, residual, lam, lam_eff) and contributors (keys, i, j, rater, lam_r).

    An edge's residual counts for each rater by the rater's part of the edge's
    weight.  Efficacy is the global mean square over the rater's, scatter the root
    of its inverse, bias the weighted median.
    """
    overall = edges.groupBy(*keys).agg((F.sum(F.col("lam_eff") * F.col("residual") * F.col("residual")) / (F.sum("lam_eff") + TINY)).alias("_all"))
    part = edges.join(contributors, [*keys, "i", "j"]).withColumn("_w", F.col("lam_eff") * F.greatest("lam_r", F.lit(0.0)) / F.greatest("lam", F.lit(TINY))).filter("_w > 0")
    own = part.groupBy(*keys, rater).agg(F.count(F.lit(1)).alias("edges"), (F.sum(F.col("_w") * F.col("residual") * F.col("residual")) / (F.sum("_w") + TINY)).alias("_own"))
    bias = weighted_median(part, [*keys, rater], "residual", "_w").withColumnRenamed("median", "bias")
    x = own.join(bias, [*keys, rater], "left").join(overall, keys)
    return x.select(*keys, rater, "edges", F.when(F.col("_own") > 0, F.col("_all") / F.col("_own")).otherwise(0.0).alias("efficacy"), "bias", F.when(F.col("_all") > 0, F.sqrt(F.col("_own") / F.col("_all"))).otherwise(0.0).alias("scatter"))


def spin_probe(readings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, susceptibility, survives, flipped_by_order) of readings (keys, framing, order, m).

    ``framing``: neutral, first or second (the side that the framing is for).  The
    belief survives if all three framings agree with the neutral direction.
    """
    per = readings.groupBy(*keys, "framing").agg(F.avg("m").alias("mean"), F.avg(F.when(F.col("order") == 0, F.col("m"))).alias("x"), F.avg(F.when(F.col("order") == 1, F.col("m"))).alias("y"))
    flipped = F.coalesce((F.signum("x") != F.signum("y")) & (F.col("x") != 0), F.lit(False))
    at = lambda k: F.max(F.when(F.col("framing") == k, F.col("mean")))
    g = per.groupBy(*keys).agg(at("neutral").alias("n"), at("first").alias("p"), at("second").alias("c"), F.count_if(flipped).alias("flipped_by_order"))
    survives = (F.signum("n") == F.signum("p")) & (F.signum("n") == F.signum("c"))
    return g.select(*keys, ((F.col("p") - F.col("c")) / 2).alias("susceptibility"), F.when(F.col("n") != 0, survives).alias("survives"), "flipped_by_order")


def consortium(coefficients: DataFrame, keys: list[str], judge: str) -> DataFrame:
    """(keys, judges, mean, spread, unanimous, bias_rms) from whole orbits (keys, judge, chi, coefficient).

    The belief is the coefficient of the trivial character; what is left is bias.
    Packets of all judges' cells with equal precision fuse to the mean belief.
    """
    c = F.col("coefficient")
    per = coefficients.groupBy(*keys, judge).agg(F.sum(F.when(F.col("chi") == 0, c)).alias("belief"), F.sqrt(F.sum(F.when(F.col("chi") != 0, c * c).otherwise(0.0))).alias("bias"))
    one_way = (F.min("belief") >= 0) | (F.max("belief") <= 0)
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("judges"), F.avg("belief").alias("mean"), F.stddev_pop("belief").alias("spread"), one_way.alias("unanimous"), F.avg("bias").alias("bias_rms")).filter("judges >= 2")


def top_bias(coefficients: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chi, coefficient): the strongest character but the trivial one; of equal ones the last."""
    rest = coefficients.filter("chi <> 0")
    return rest.groupBy(*keys).agg(F.max_by(F.struct("chi", "coefficient"), F.struct(F.round(F.abs("coefficient"), 9), F.col("chi"))).alias("b")).select(*keys, "b.chi", "b.coefficient")


def residual_correlation(cells: DataFrame, keys: list[str], judge: str) -> DataFrame:
    """(keys, judge_a, judge_b, r) of the judges' eight cells; 0 without spread."""
    a = cells.select(*keys, "g", F.col(judge).alias("judge_a"), F.col("m").alias("x"))
    b = cells.select(*keys, "g", F.col(judge).alias("judge_b"), F.col("m").alias("y"))
    p = a.join(b, [*keys, "g"]).filter("judge_a < judge_b").groupBy(*keys, "judge_a", "judge_b")
    flat = (F.var_pop("x") * 8 <= 1e-15) | (F.var_pop("y") * 8 <= 1e-15)
    return p.agg(F.count(F.lit(1)).alias("n"), F.when(flat, 0.0).otherwise(F.corr("x", "y")).alias("r")).filter("n = 8").drop("n")


def mean_interval(value: Column) -> list[Column]:
    """n, mean and half width of the 95 % interval."""
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), (Z95 * F.stddev_samp(value) / F.sqrt(F.count(value))).alias("half_width")]


def nuisance_drift(readings: DataFrame, keys: list[str], kind: str, core: str) -> DataFrame:
    """(kind, n, mean, half_width) of how far readings (keys, kind, m) lie from the same key's core reading."""
    base = readings.filter(F.col(kind) == core).groupBy(*keys).agg(F.avg("m").alias("_base"))
    rest = readings.filter(F.col(kind) != core).join(base, keys)
    return rest.groupBy(kind).agg(*mean_interval(F.abs(F.col("m") - F.col("_base"))))


def draw_stats(readings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, draws, mean, sd, spread, sign_minority, distinct, duplicate_rate) of repeated draws."""
    n = F.count(F.lit(1))
    return readings.groupBy(*keys).agg(
        n.alias("draws"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), (F.max("m") - F.min("m")).alias("spread"),
        (F.least(F.count_if(F.col("m") > 0), F.count_if(F.col("m") < 0)) / n).alias("sign_minority"),
        F.count_distinct(F.round("m", 9)).alias("distinct"), (1 - F.count_distinct(F.round("m", 9)) / n).alias("duplicate_rate"),
    ).filter("draws >= 2")


def merge_slates(proposals: DataFrame, attribute: Column, backer: str) -> DataFrame:
    """(attribute, backers, breadth, place): proposals with the same wording merged, the broadest first."""
    g = proposals.select(attribute.alias("attribute"), F.col(backer).alias("_b")).filter("attribute is not null and attribute <> ''").groupBy("attribute").agg(F.array_join(F.array_sort(F.collect_set("_b")), ",").alias("backers"), F.count_distinct("_b").alias("breadth"))
    # one row for each wording: the slate itself
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("breadth"), "attribute")))


def pair_cover(members: DataFrame, keys: list[str], entity: str, size: int) -> DataFrame:
    """(keys, block, entity): sets of at most ``size`` such that every two members of a group share one.

    Members are cut into chunks of half that size; every two chunks make a set, a lone chunk its own.
    """
    half = max(size // 2, 1)
    w = Window.partitionBy(*keys)
    x = members.select(*keys, entity).withColumns({"_c": F.floor((F.row_number().over(w.orderBy(entity)) - 1) / half), "_n": F.ceil(F.count(F.lit(1)).over(w) / half)})
    # each chunk meets every other: its sets are named by both numbers
    others = F.when(F.col("_n") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda k: k != F.col("_c")))
    x = x.withColumn("_o", F.explode(others))
    return x.select(*keys, F.concat_ws("-", F.least("_c", "_o"), F.greatest("_c", "_o")).alias("block"), entity)


def minmax_utility(scores: DataFrame, axis: str, entity: str, value: str, weight: str) -> DataFrame:
    """(entity, utility, place): weighted sum of the axes' scores scaled to 0..1 (0.5 on a constant axis), ties by id."""
    span = scores.groupBy(axis).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    near = F.abs(F.col("_hi") - F.col("_lo")) <= 1e-9 * F.greatest(F.abs("_hi"), F.abs("_lo"))
    unit = F.when(near, 0.5).otherwise((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return scores.join(F.broadcast(span), axis).groupBy(entity).agg(F.sum(F.col(weight) * unit).alias("utility"))


def confidence_curve(residuals: DataFrame, keys: list[str], confidence: str, residual: str, gammas: list[float], floors: list[float]) -> DataFrame:
    """(keys, gamma, floor, nll, flat_nll): the weight curve floor + (1 - floor) * c^gamma that a Gaussian finds likeliest.

    Only counts and sums of squares by confidence meet the grid.
    """
    cells = residuals.groupBy(*keys, confidence).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(residual) * F.col(residual)).alias("ss"))
    grid = cells.withColumn("gamma", F.explode(F.array(*map(F.lit, gammas)))).withColumn("floor", F.explode(F.array(*map(F.lit, floors))))
    g = F.greatest(F.col("floor") + (1 - F.col("floor")) * F.pow(F.col(confidence), F.col("gamma")), F.lit(1e-9))
    s = grid.groupBy(*keys, "gamma", "floor").agg(F.sum("n").alias("n"), F.sum(g * F.col("ss")).alias("q"), F.sum(F.col("n") * F.log(g)).alias("l"), F.sum("ss").alias("all"))
    s = s.filter("q > 0")
    nll = F.col("n") / 2 * F.log(F.col("q") / F.col("n")) - F.col("l") / 2
    flat = F.col("n") / 2 * F.log(F.col("all") / F.col("n"))
    s = s.withColumns({"nll": nll, "flat_nll": flat})
    best = F.min_by(F.struct("gamma", "floor", "nll", "flat_nll", "n"), F.struct(F.round("nll", 6), F.col("gamma"), F.col("floor")))
    return s.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def certified(band: DataFrame, degrees: DataFrame, labels: DataFrame, keys: list[str], k: int, beta: float, least_degree: int = 2) -> DataFrame:
    """(keys, weakest, challenger, certified, reason) of a stop test on bounds (keys, entity_id, rank, s, v, lcb, ucb).

    Certified if the weakest of the top k by lower bound lies above the strongest
    outside by upper bound, both have ``least_degree`` pairs and share the leader's
    component, and their difference is above ``beta`` standard deviations of it.
    """
    x = band.join(degrees, [*keys, "entity_id"], "left").join(labels, [*keys, "entity_id"], "left").fillna(0, ["degree"])
    inside = F.col("rank") <= k
    row = F.struct("entity_id", "s", "v", "lcb", "ucb", "degree", "component")
    g = x.groupBy(*keys).agg(
        F.min_by(F.when(inside, row), F.when(inside, F.struct("lcb", "entity_id"))).alias("i"),
        F.max_by(F.when(~inside, row), F.when(~inside, F.struct("ucb", "entity_id"))).alias("j"),
        F.max(F.when(F.col("rank") == 1, F.col("component"))).alias("anchor"),
    )
    apart = F.col("i.s") - F.col("j.s") - beta * F.sqrt(F.greatest(F.col("i.v") + F.col("j.v"), F.lit(0.0))) > 0
    reason = (
        F.when(F.col("i").isNull() | F.col("j").isNull(), "no critical pair")
        .when(F.least("i.degree", "j.degree") < least_degree, "degree")
        .when(~((F.col("i.component") == F.col("anchor")) & (F.col("j.component") == F.col("anchor"))), "component")
        .when(F.col("i.component").isNull() | F.col("j.component").isNull() | F.col("anchor").isNull(), "component")
        .when(F.col("i.lcb") <= F.col("j.ucb"), "bounds overlap")
        .when(~apart, "difference")
    )
    return g.select(*keys, F.col("i.entity_id").alias("weakest"), F.col("j.entity_id").alias("challenger"), reason.isNull().alias("certified"), F.coalesce(reason, F.lit("certified")).alias("reason"))


def stop_streaks(rounds: DataFrame, keys: list[str], order: str, ok: str, least: int) -> DataFrame:
    """``streak`` of rounds in a row that were certified, and whether the loop may ``stop``; any other round starts anew."""
    w = Window.partitionBy(*keys).orderBy(order)
    x = rounds.withColumn("_island", F.sum(F.when(F.col(ok), 0).otherwise(1)).over(w))
    streak = F.sum(F.col(ok).cast("int")).over(Window.partitionBy(*keys, "_island").orderBy(order))
    return x.withColumn("streak", streak).withColumn("stop", F.col("streak") >= max(least, 1)).drop("_island")


def boundary(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, k, boundary, s): a whole list is sorted with k at half of it; the boundary is its k-th entity."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    x = ranked.withColumn("n", n).withColumn("k", F.ceil(F.col("n") / 2))
    return x.filter(F.col("rank") == F.col("k")).select(*keys, "n", "k", F.col("entity_id").alias("boundary"), "s")
