"""Which comparisons to make next: gains of candidate pairs, frontiers, schedules, designs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.operators.ranking import flip_probability, pair_rank_weight, ranked, uncertainty_band


def edge_gains(nodes: DataFrame, keys: list[str], k: int, lam: float = 1.0, lambda_risk: float = 1.0, mode: str = "hybrid", cost: float = 1.0) -> DataFrame:
    """Gain of comparing each pair of a group, from the marginal variances.

    Information 1/2 ln(1 + lam R); risk, the fall of the weighed flip probability when
    R becomes R / (1 + lam R); ``mode`` information, order or hybrid.
    """
    r = ranked(nodes, keys)
    side = lambda x: r.select(*keys, F.col("entity_id").alias(x), F.col("s").alias(f"s_{x}"), F.col("v").alias(f"v_{x}"), F.col("rank").alias(f"r_{x}"))
    p = side("hi").join(side("lo"), keys).filter("r_hi < r_lo")
    big_r = F.col("v_hi") + F.col("v_lo")
    d = F.col("s_hi") - F.col("s_lo")
    info = F.log(1 + lam * big_r) / 2
    risk = pair_rank_weight(k) * (flip_probability(d, big_r) - flip_probability(d, big_r / (1 + lam * big_r)))
    score = {"information": info, "order": risk, "hybrid": info + lambda_risk * risk}[mode] / cost
    return p.select(*keys, F.least("hi", "lo").alias("i"), F.greatest("hi", "lo").alias("j"), info.alias("d_info"), risk.alias("d_risk"), score.alias("gain"))


def best_pairs(gains: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n best pairs of each group, ties by pair."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("gain", 9)), "i", "j")
    return gains.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def best_edges(nodes: DataFrame, keys: list[str], k: int, n: int, lam: float = 1.0, lambda_risk: float = 1.0) -> DataFrame:
    """The n pairs of each group with the greatest hybrid gain, as ``best_pairs(edge_gains(...))`` gives them, for less.

    A pair's risk part is at most half its weight, and the n greatest information
    parts are among the n + 1 widest entities; so a pair whose bound lies below
    the n-th of those can't be among the best, and no flip probability is worked
    out for it.
    """
    r = ranked(nodes, keys)
    w = Window.partitionBy(*keys)
    wide = r.withColumn("_q", F.row_number().over(w.orderBy(F.desc("v"), "entity_id"))).filter(F.col("_q") <= n + 1)
    a, b = (wide.select(*keys, F.col("_q").alias(f"_q{x}"), F.col("v").alias(f"_v{x}")) for x in "ab")
    floor = a.join(b, keys).filter("_qa < _qb").withColumn("_info", F.log(1 + lam * (F.col("_va") + F.col("_vb"))) / 2)
    floor = floor.withColumn("_n", F.row_number().over(w.orderBy(F.desc("_info")))).filter(F.col("_n") == n).select(*keys, F.col("_info").alias("_least"))
    side = lambda x: r.select(*keys, F.col("entity_id").alias(x), F.col("s").alias(f"s_{x}"), F.col("v").alias(f"v_{x}"), F.col("rank").alias(f"r_{x}"))
    p = side("hi").join(floor, keys, "left").join(side("lo"), keys).filter("r_hi < r_lo")
    big_r, d = F.col("v_hi") + F.col("v_lo"), F.col("s_hi") - F.col("s_lo")
    info = F.log(1 + lam * big_r) / 2
    p = p.filter(F.col("_least").isNull() | (info + lambda_risk * pair_rank_weight(k) / 2 >= F.col("_least") - 1e-8))
    risk = pair_rank_weight(k) * (flip_probability(d, big_r) - flip_probability(d, big_r / (1 + lam * big_r)))
    gains = p.select(*keys, F.least("hi", "lo").alias("i"), F.greatest("hi", "lo").alias("j"), info.alias("d_info"), risk.alias("d_risk"), (info + lambda_risk * risk).alias("gain"))
    return best_pairs(gains, keys, n)


def frontier(nodes: DataFrame, keys: list[str], k: int, each: int, beta: float = 1.96) -> DataFrame:
    """Weakest incumbents against strongest challengers of the band, at most ``each`` of both."""
    b = uncertainty_band(nodes, keys, k, beta).filter("in_band")
    w = Window.partitionBy(*keys)
    top = b.filter(F.col("rank") <= k).withColumn("_n", F.row_number().over(w.orderBy("lcb", "entity_id"))).filter(F.col("_n") <= each)
    out = b.filter(F.col("rank") > k).withColumn("_n", F.row_number().over(w.orderBy(F.desc("ucb"), "entity_id"))).filter(F.col("_n") <= each)
    return top.select(*keys, F.col("entity_id").alias("incumbent")).join(out.select(*keys, F.col("entity_id").alias("challenger")), keys)


def explore_needy(nodes: DataFrame, edges: DataFrame, keys: list[str], least: int = 2, stride: int = 5) -> DataFrame:
    """Entities of fewer than ``least`` pairs, each with an anchor of the same group (every ``stride``-th by id)."""
    ends = edges.select(*keys, F.explode(F.array("i", "j")).alias("entity_id")).groupBy(*keys, "entity_id").agg(F.count(F.lit(1)).alias("degree"))
    d = nodes.select(*keys, "entity_id").join(ends, [*keys, "entity_id"], "left").fillna(0, ["degree"])
    w = Window.partitionBy(*keys).orderBy("entity_id")
    d = d.withColumn("_p", F.row_number().over(w) - 1)
    anchors = d.filter(F.col("_p") % stride == 0).select(*keys, F.col("entity_id").alias("anchor"), F.floor(F.col("_p") / stride).alias("_a"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_m"))
    needy = d.filter(F.col("degree") < least)
    on = [*keys]
    return needy.join(anchors, on).filter((F.pmod(F.col("_p"), F.col("_m")) == F.col("_a")) & (F.col("anchor") != F.col("entity_id"))).select(*keys, "entity_id", "degree", "anchor")


def proposals(nodes: DataFrame, edges: DataFrame, keys: list[str], k: int, batch: int) -> DataFrame:
    """A batch for each group: exploration first, then the frontier and the best gains, each pair once."""
    pair = lambda a, b: (F.least(a, b).alias("i"), F.greatest(a, b).alias("j"))
    x = explore_needy(nodes, edges, keys).select(*keys, *pair("entity_id", "anchor"), F.lit(0).alias("kind"), F.lit(0.0).alias("gain"))
    y = frontier(nodes, keys, k, 3).select(*keys, *pair("incumbent", "challenger"), F.lit(1).alias("kind"), F.lit(0.0).alias("gain"))
    z = best_edges(nodes, keys, k, batch).select(*keys, "i", "j", F.lit(2).alias("kind"), "gain")
    once = x.unionByName(y).unionByName(z).groupBy(*keys, "i", "j").agg(F.min("kind").alias("kind"), F.max("gain").alias("gain"))
    w = Window.partitionBy(*keys).orderBy("kind", F.desc(F.round("gain", 9)), "i", "j")
    return once.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= batch)


def round_robin(spark: SparkSession, n: int) -> DataFrame:
    """(round, slot, a, b) of a schedule in which each of n meets every other once, by the circle method."""
    m = n + n % 2
    r = spark.range(max(m - 1, 0)).withColumnRenamed("id", "round").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(m // 2 - 1))))
    a = F.when(F.col("slot") == 0, F.lit(m - 1)).otherwise(F.pmod(F.col("round") + F.col("slot"), F.lit(m - 1)))
    b = F.pmod(F.col("round") - F.col("slot"), F.lit(m - 1))
    x = r.withColumns({"x": a, "y": b}).filter((F.col("x") < n) & (F.col("y") < n))
    return x.select("round", "slot", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def circulant(spark: SparkSession, n: int, strides: Column) -> DataFrame:
    """Ring pairs (i, i + s mod n) of each stride, each once."""
    x = spark.range(n).withColumn("s", F.explode(strides)).withColumn("k", F.pmod(F.col("id") + F.col("s"), F.lit(n)))
    return x.filter("id <> k").select(F.least("id", "k").alias("a"), F.greatest("id", "k").alias("b")).distinct()


def doubling_strides(n: int) -> Column:
    return F.array(*[F.lit(1 << k) for k in range(max(n // 2, 1).bit_length()) if 1 << k <= max(n // 2, 1)])


def lower_tiers(tiers: DataFrame, keys: list[str]) -> DataFrame:
    """Every entity of a better tier over every one of a worse tier of the same call, as ordinal observations."""
    a = tiers.select(*keys, F.col("tier").alias("ta"), F.col("entity_id").alias("winner"))
    b = tiers.select(*keys, F.col("tier").alias("tb"), F.col("entity_id").alias("loser"))
    return a.join(b, keys).filter("ta < tb").select(*keys, "winner", "loser")
