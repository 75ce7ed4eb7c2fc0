"""Consistency probes over readings: orbits, wordings, spin, transitivity, twins, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orbit(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chi, coefficient) of readings m over g = 0..7 (bits: order, polarity, wording); only whole orbits."""
    whole = cells.groupBy(*keys).agg(F.count_distinct("g").alias("_n")).filter("_n = 8").drop("_n")
    x = cells.join(whole, keys).withColumn("chi", F.explode(F.sequence(F.lit(0), F.lit(7))))
    sign = F.when(F.bit_count(F.col("chi").bitwiseAND(F.col("g"))) % 2 == 1, -1.0).otherwise(1.0)
    return x.groupBy(*keys, "chi").agg((F.sum(F.col("m") * sign) / 8).alias("coefficient"))


def orbit_summary(coefficients: DataFrame, keys: list[str]) -> DataFrame:
    """Belief, share of the energy in it, and share in the interactions (chi 3, 5, 6, 7)."""
    e = F.col("coefficient") * F.col("coefficient")
    g = coefficients.groupBy(*keys).agg(F.sum(F.when(F.col("chi") == 0, F.col("coefficient"))).alias("belief"), F.sum(F.when(F.col("chi") == 0, e)).alias("e0"), F.sum(F.when(F.col("chi").isin(3, 5, 6, 7), e)).alias("ei"), F.sum(e).alias("energy"))
    return g.select(*keys, "belief", "energy", F.when(F.col("energy") > 0, F.col("e0") / F.col("energy")).alias("coherence"), F.when(F.col("energy") > 0, F.col("ei") / F.col("energy")).alias("interaction"))


def wording_gap(readings: DataFrame, keys: list[str], wording: str) -> DataFrame:
    """Largest gap of the mean reading between wordings, and whether all agree on the direction."""
    per = readings.groupBy(*keys, wording).agg(F.avg("m").alias("mean"))
    g = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("wordings"), (F.max("mean") - F.min("mean")).alias("gap"), (F.min(F.signum("mean")) == F.max(F.signum("mean"))).alias("consistent"))
    return g.filter("wordings >= 2")


def spin_sweep(readings: DataFrame, keys: list[str], field: str) -> DataFrame:
    """Least-squares slope and R2 of the reading over the field; null without spread."""
    return readings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.var_pop(field) > 0, F.covar_pop("m", field) / F.var_pop(field)).alias("slope"),
        F.when((F.var_pop(field) > 0) & (F.var_pop("m") > 0), F.pow(F.corr("m", field), 2)).alias("r2"),
        F.avg("m").alias("even"),
    )


def pair_shares(readings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, j, p, k): share of the readings for i, ties one half."""
    up = F.when(F.col("m") > 0, 1.0).when(F.col("m") == 0, 0.5).otherwise(0.0)
    return readings.groupBy(*keys, "i", "j").agg(F.avg(up).alias("p"), F.count(F.lit(1)).alias("k"))


def triads(edges: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every triangle x < y < z with the values of xy, yz and xz, by equi-joins."""
    e = edges.select(*keys, F.col("i").alias("x"), F.col("j").alias("y"), F.col(value).alias("xy"))
    f = edges.select(*keys, F.col("i").alias("y"), F.col("j").alias("z"), F.col(value).alias("yz"))
    g = edges.select(*keys, F.col("i").alias("x"), F.col("j").alias("z"), F.col(value).alias("xz"))
    return e.join(f, [*keys, "y"]).join(g, [*keys, "x", "z"])


def transitivity(shares: DataFrame, keys: list[str]) -> DataFrame:
    """Triads and how many break weak, moderate and strong stochastic transitivity.

    A triad is oriented so that both premises are at least one half; the six
    orders are tried in a fixed sequence and the first that fits is taken.
    """
    t = triads(shares, keys, "p")
    xy, yz, xz = F.col("xy"), F.col("yz"), F.col("xz")
    orders = [(xy, yz, xz), (xz, 1 - yz, xy), (1 - xy, xz, yz), (yz, 1 - xz, 1 - xy), (1 - xz, xy, 1 - yz), (1 - yz, 1 - xy, 1 - xz)]
    oriented = F.coalesce(*[F.when((a >= 0.5) & (b >= 0.5), F.struct(a.alias("a"), b.alias("b"), c.alias("c"))) for a, b, c in orders])
    o = t.withColumn("o", oriented).filter("o is not null")
    a, b, c = F.col("o.a"), F.col("o.b"), F.col("o.c")
    return o.groupBy(*keys).agg(F.count(F.lit(1)).alias("triads"), F.count_if(c < 0.5).alias("weak"), F.count_if(c < F.least(a, b)).alias("moderate"), F.count_if(c < F.greatest(a, b)).alias("strong"))


def cyclic(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Triangles and those in which each entity wins once; ``mu`` decides."""
    t = triads(edges.filter("mu <> 0"), keys, "mu")
    round_trip = ((F.col("xy") > 0) & (F.col("yz") > 0) & (F.col("xz") < 0)) | ((F.col("xy") < 0) & (F.col("yz") < 0) & (F.col("xz") > 0))
    return t.groupBy(*keys).agg(F.count(F.lit(1)).alias("triangles"), F.count_if(round_trip).alias("cyclic"))


def cross_judge(readings: DataFrame, keys: list[str], judge: str = "model", order: Column | None = None) -> DataFrame:
    """Share of pairs on which two judges name the same winner, the last reading of each counting."""
    last = readings.groupBy(*keys, "i", "j", judge).agg(F.max_by(F.signum("m"), order).alias("w"))
    a = last.select(*keys, "i", "j", F.col(judge).alias("judge_a"), F.col("w").alias("wa"))
    b = last.select(*keys, "i", "j", F.col(judge).alias("judge_b"), F.col("w").alias("wb"))
    both = a.join(b, [*keys, "i", "j"]).filter("judge_a < judge_b")
    return both.groupBy(*keys, "judge_a", "judge_b").agg(F.count(F.lit(1)).alias("pairs"), F.avg((F.col("wa") == F.col("wb")).cast("double")).alias("agreement"))


def histogram(rows: DataFrame, keys: list[str], value: Column, bins: int) -> DataFrame:
    """Counts in equal bins of 0..1, the last closed, values outside clamped."""
    b = F.greatest(F.least(F.floor(value * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    return rows.withColumn("bin", b).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
