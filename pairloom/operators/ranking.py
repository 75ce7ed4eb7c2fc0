"""Ranks, units, utilities, bands and dominance over solved scores.

``nodes`` has the keys of a solved group, ``entity_id``, ``s`` (score) and ``v``
(variance).  Windows run over one solved group, which the solver bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.math import correlation, normal_cdf

TINY, INF = 1e-18, float("inf")
#: z for a tolerated error of at most so much.
BETAS = ((0.01, 2.58), (0.05, 1.96), (0.1, 1.64))


def ranked(nodes: DataFrame, keys: list[str], score: str = "s") -> DataFrame:
    """Position by score, best first, ties by id; and the weight 1 / position."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), "entity_id")
    return nodes.withColumn("rank", F.row_number().over(w)).withColumn("rank_weight", 1 / F.col("rank"))


def flip_probability(delta: Column, variance: Column) -> Column:
    """That the order of two scores is really the other one; a step where the variance is nought."""
    sure = F.when(delta == 0, 0.5).otherwise(0.0)
    return F.when(delta == 0, 0.5).when(variance <= TINY, sure).otherwise(normal_cdf(-F.abs(delta) / F.sqrt(variance)))


def rank_pairs(nodes: DataFrame, keys: list[str], band: int = 5, gap: float = 0.5, cap: int = 200_000) -> DataFrame:
    """Pairs within ``band`` positions or ``gap`` of score; the first ``cap`` by position in each group."""
    r = ranked(nodes, keys)
    left = r.select(*keys, F.col("entity_id").alias("hi"), F.col("s").alias("s_hi"), F.col("v").alias("v_hi"), F.col("rank").alias("r_hi"))
    right = r.select(*keys, F.col("entity_id").alias("lo"), F.col("s").alias("s_lo"), F.col("v").alias("v_lo"), F.col("rank").alias("r_lo"))
    near = (F.col("r_lo") - F.col("r_hi") <= band) | (F.col("s_hi") - F.col("s_lo") <= gap)
    pairs = left.join(right, keys).filter((F.col("r_hi") < F.col("r_lo")) & near)
    order = Window.partitionBy(*keys).orderBy("r_hi", "r_lo")
    return pairs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= cap).drop("_n")


def pair_rank_weight(k: int, tail: float = 0.25, exponent: float = 1.0) -> Column:
    """Mean of both positions' weights; damped where both lie outside the top k."""
    mean = (F.pow(F.col("r_hi").cast("double"), F.lit(-exponent)) + F.pow(F.col("r_lo").cast("double"), F.lit(-exponent))) / 2
    return F.when((F.col("r_hi") > k) & (F.col("r_lo") > k), mean * tail).otherwise(mean)


def rank_stability(nodes: DataFrame, keys: list[str], k: int = 5, **options) -> DataFrame:
    """Expected reversals, the likeliest one, and their weighted sum."""
    p = rank_pairs(nodes, keys, **options).withColumn("flip", flip_probability(F.col("s_hi") - F.col("s_lo"), F.col("v_hi") + F.col("v_lo")))
    return p.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.sum("flip").alias("expected_reversals"), F.max("flip").alias("max_reversal"), F.sum(F.col("flip") * pair_rank_weight(k)).alias("rank_risk"))


def attribute_units(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Scale (unscaled MAD; population sigma where that is nought), z, min-norm and percentile of each score."""
    clean = nodes.withColumn("s", F.when(F.isnan("s") | (F.abs("s") == INF), 0.0).otherwise(F.col("s")))
    w, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("s", "entity_id")
    x = clean.withColumn("med", F.median("s").over(w))
    x = x.withColumn("mad", F.median(F.abs(F.col("s") - F.col("med"))).over(w))
    fallback = F.greatest(F.stddev_pop("s").over(w), F.lit(1e-6)) / 1.4826
    x = x.withColumn("scale", F.when(F.col("mad") < 1e-6, fallback).otherwise(F.col("mad")))
    return x.select(
        *keys,
        "entity_id",
        "s",
        "v",
        "scale",
        ((F.col("s") - F.col("med")) / (F.col("scale") * 1.4826)).alias("z"),
        (F.col("s") - F.min("s").over(w) + 1).alias("min_norm"),
        ((F.row_number().over(order) - 0.5) / F.count(F.lit(1)).over(w)).alias("percentile"),
    )


def gate(unit: Column, op: Column, threshold: Column) -> Column:
    """Whether one gate lets an entity pass."""
    value = F.when(unit == "latent", F.col("s")).when(unit == "z", F.col("z")).when(unit == "min_norm", F.col("min_norm")).when(unit == "percentile", F.col("percentile"))
    return F.when(op == ">=", value >= threshold).when(op == "<=", value <= threshold)


def robust_capped_sum(values: Column) -> Column:
    """Sum with each value capped at max(q3 + 3 IQR, 10 medians, 1e-12); index quartiles; plain for two or fewer."""
    x, n = F.array_sort(values), F.size(values)
    q1, q3 = F.element_at(x, F.floor(n / 4).cast("int") + 1), F.element_at(x, F.least(F.floor(n * 3 / 4), n - 1).cast("int") + 1)
    half = F.floor(n / 2).cast("int")
    med = F.when(n % 2 == 1, F.element_at(x, half + 1)).otherwise((F.element_at(x, F.greatest(half, F.lit(1))) + F.element_at(x, half + 1)) / 2)
    fence = F.greatest(q3 + 3 * (q3 - q1), 10 * med, F.lit(1e-12))
    plain = F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    return F.when(n <= 2, plain).otherwise(F.aggregate(x, F.lit(0.0), lambda a, b: a + F.least(b, fence)))


def beta_for(tolerated_error: float) -> float:
    return next((b for e, b in BETAS if tolerated_error <= e), 1.28)


def uncertainty_band(nodes: DataFrame, keys: list[str], k: int, beta: float = 1.96) -> DataFrame:
    """Entities whose place relative to the top k is open, with the probability that they are on the wrong side of the k-th.

    With at most k entities nothing is open and nothing can flip.
    """
    r = ranked(nodes, keys)
    sd = F.sqrt(F.greatest("v", F.lit(0.0)))
    r = r.withColumns({"lcb": F.col("s") - beta * sd, "ucb": F.col("s") + beta * sd})
    w = Window.partitionBy(*keys)
    by_l, by_u = w.orderBy(F.desc("lcb"), "entity_id"), w.orderBy(F.desc("ucb"), "entity_id")
    r = r.withColumns({"_l": F.row_number().over(by_l), "_u": F.row_number().over(by_u), "n": F.count(F.lit(1)).over(w)})
    kth = lambda c, at, cond: F.max(F.when(cond == at, F.col(c))).over(w)
    r = r.withColumns({"theta_l": kth("lcb", k, F.col("_l")), "theta_u": kth("ucb", k + 1, F.col("_u")), "s_k": kth("s", k, F.col("rank")), "v_k": kth("v", k, F.col("rank"))})
    few = F.col("n") <= k
    inside = ~few & (F.col("ucb") >= F.col("theta_l")) & (F.col("lcb") <= F.col("theta_u"))
    both = F.sqrt(F.greatest("v", F.lit(0.0))) + F.sqrt(F.greatest("v_k", F.lit(0.0)))
    flip = F.when(few, 0.0).otherwise(flip_probability(F.col("s") - F.col("s_k"), both * both))
    return r.select(*keys, "entity_id", "rank", "lcb", "ucb", F.coalesce(inside, F.lit(False)).alias("in_band"), flip.alias("p_flip"))


def critical_pair(nodes: DataFrame, keys: list[str], k: int, beta: float = 1.96) -> DataFrame:
    """The weakest of the top k by lower bound and the strongest outside by upper bound."""
    b = uncertainty_band(nodes, keys, k, beta)
    inside = F.col("rank") <= k
    return b.groupBy(*keys).agg(
        F.min_by(F.when(inside, F.col("entity_id")), F.when(inside, F.struct("lcb", "entity_id"))).alias("weakest"),
        F.max_by(F.when(~inside, F.col("entity_id")), F.when(~inside, F.struct("ucb", "entity_id"))).alias("challenger"),
        (F.min(F.when(inside, F.col("lcb"))) - F.max(F.when(~inside, F.col("ucb")))).alias("separation"),
    )


def topk_error(nodes: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Sum over incumbents and challengers of the probability that their order is wrong."""
    r = ranked(nodes, keys)
    top = r.filter(F.col("rank") <= k).select(*keys, F.col("s").alias("s_in"), F.col("v").alias("v_in"))
    rest = r.filter(F.col("rank") > k).select(*keys, F.col("s").alias("s_out"), F.col("v").alias("v_out"))
    p = top.join(rest, keys).withColumn("p", flip_probability(F.col("s_in") - F.col("s_out"), F.col("v_in") + F.col("v_out")))
    return p.groupBy(*keys).agg(F.sum("p").alias("topk_error"))


def pareto_front(vectors: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of each group that no other row of it matches everywhere and beats somewhere."""
    other = vectors.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"_{c}") for c in columns])
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    better = F.lit(False)
    for c in columns:
        on, better = on & (F.col(f"_{c}") >= F.col(c)), better | (F.col(f"_{c}") > F.col(c))
    return vectors.join(other, on & better, "left_anti")


def spearman(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Correlation of average ranks in each group; null below three rows or without spread."""
    w = Window.partitionBy(*keys)
    out = pairs
    for c in (x, y):
        out = out.withColumn(f"_r{c}", F.row_number().over(w.orderBy(c)))
        out = out.withColumn(f"_a{c}", F.avg(f"_r{c}").over(Window.partitionBy(*keys, c)))
    n = F.count(F.lit(1))
    spread = (F.stddev_pop(f"_a{x}") > 1e-12) & (F.stddev_pop(f"_a{y}") > 1e-12)
    return out.groupBy(*keys).agg(n.alias("n"), F.when((n >= 3) & spread, correlation(f"_a{x}", f"_a{y}")).alias("rho"))
