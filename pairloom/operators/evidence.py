"""Judgements to observations, and observations to fused edges and their statistics.

Functions take and return DataFrames.  Canonical columns: ``i < j`` the pair,
``m`` the log-ratio of i over j, ``lam`` the weight (``beta * precision * reps /
temperature``), ``mu`` the weighted mean.  Stated confidence is never a weight.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.keys import clean_key
from pairloom.operators.dedup import comparison_identifier, current_rows, delivery_order

MAX_LOG_RATIO, MAX_REPS, TINY, VARIANCE_FLOOR = 10.0, 1000.0, 1e-18, 1e-3


def current(comparisons: DataFrame, *columns: str) -> DataFrame:
    """The current row of each identifier with ``columns`` and the cleaned ``run``, ``ah``, ``bh``."""
    keyed = comparisons.withColumns({"run": clean_key("run_id"), "ah": clean_key("entity_a_hash"), "bh": clean_key("entity_b_hash")})
    return current_rows(keyed, comparison_identifier(), delivery_order(), list(dict.fromkeys([*columns, "run"])))


def signed_log_ratio(higher: Column, ratio: Column, refused: Column | None = None) -> Column:
    """Log-ratio toward the first side; at least 0 in size; null for a refusal or no winner."""
    value = F.when(higher == "A", 1.0).when(higher == "B", -1.0) * F.log(F.greatest(ratio, F.lit(1.0)))
    return value if refused is None else F.when(refused == 0, value)


def unswapped(value: Column, swapped: Column) -> Column:
    """A value toward the first presented side, turned toward the first entity of the pair."""
    return F.when(swapped == 1, -value).otherwise(value)


def usable_ratio(ratio: Column) -> Column:
    return ratio.isNotNull() & ~F.isnan(ratio) & (F.abs(ratio) != F.lit(float("inf"))) & (ratio > 0)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def observations(comparisons: DataFrame, *extra: str) -> DataFrame:
    """Sanitised observations of the current rows, canonically oriented.

    Dropped: refusals, errors, no winner, an entity against itself, ratios that
    are null, not finite or not above 0.
    """
    carry = ["axis_key", "model", "entity_a_id", "entity_b_id", "higher_ranked", "ratio", "refused", "error", *extra]
    rows = current(comparisons, *carry)
    good = (F.col("refused") == 0) & (F.col("error") == "") & F.col("higher_ranked").isin("A", "B") & (F.col("entity_a_id") != F.col("entity_b_id")) & usable_ratio(F.col("ratio"))
    up = (F.col("higher_ranked") == "A") == (F.col("entity_a_id") < F.col("entity_b_id"))
    m = clamp(F.when(up, 1.0).otherwise(-1.0) * F.log(F.greatest("ratio", F.lit(TINY))), -MAX_LOG_RATIO, MAX_LOG_RATIO)
    return rows.filter(good).select(
        "run",
        "axis_key",
        "model",
        F.col("entity_a_id").alias("a"),
        F.col("entity_b_id").alias("b"),
        F.least("entity_a_id", "entity_b_id").alias("i"),
        F.greatest("entity_a_id", "entity_b_id").alias("j"),
        m.alias("m"),
        signed_log_ratio(F.col("higher_ranked"), F.col("ratio")).alias("m_first"),
        "ratio",
        "higher_ranked",
        *[c for c in extra if c not in ("model",)],
    )


def weight(beta: Column | float = 1.0, precision: Column | None = None, reps: Column | float = 1.0, temperature: float = 1.0) -> Column:
    """lambda of one observation."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    base = F.greatest(lit(beta), F.lit(TINY)) * clamp(lit(reps), 0.0, MAX_REPS) / F.lit(max(temperature, TINY))
    return base if precision is None else base * F.coalesce(precision, F.lit(1.0))


def from_moments(mean: Column, variance: Column) -> tuple[Column, Column]:
    """(m, precision) of an observation given by its moments, the variance floored."""
    return clamp(mean, -MAX_LOG_RATIO, MAX_LOG_RATIO), 1 / F.greatest(variance, F.lit(VARIANCE_FLOOR))


def fuse(observed: DataFrame, *keys: str, lam: Column | None = None) -> DataFrame:
    """Edges (keys, i, j, mu, lam, n) of observations; sums only, so partial results of any split add up."""
    w = F.lit(1.0) if lam is None else lam
    sums = observed.filter(w > 0).groupBy(*keys, "i", "j").agg(F.sum(w * F.col("m")).alias("weighted"), F.sum(w).alias("lam"), F.count(F.lit(1)).alias("n"))
    return sums.select(*keys, "i", "j", (F.col("weighted") / F.col("lam")).alias("mu"), "lam", "n")


def fuse_increment(edges: DataFrame, more: DataFrame, *keys: str) -> DataFrame:
    """Edges after further observations: the fused state is a commutative monoid."""
    old = edges.select(*keys, "i", "j", (F.col("mu") * F.col("lam")).alias("weighted"), "lam", "n")
    new = fuse(more, *keys).select(*keys, "i", "j", (F.col("mu") * F.col("lam")).alias("weighted"), "lam", "n")
    sums = old.unionByName(new).groupBy(*keys, "i", "j").agg(F.sum("weighted").alias("weighted"), F.sum("lam").alias("lam"), F.sum("n").alias("n"))
    return sums.select(*keys, "i", "j", (F.col("weighted") / F.col("lam")).alias("mu"), "lam", "n")


def fuse_with_contributors(observed: DataFrame, *keys: str) -> DataFrame:
    """Edges with a map of each rater's weight, from a two-level aggregate."""
    per = observed.groupBy(*keys, "i", "j", "model").agg(F.sum("m").alias("weighted"), F.count(F.lit(1)).cast("double").alias("lam"))
    entry = F.struct("model", "lam")
    edges = per.groupBy(*keys, "i", "j").agg(F.sum("weighted").alias("weighted"), F.sum("lam").alias("lam"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("contributors"))
    return edges.select(*keys, "i", "j", (F.col("weighted") / F.col("lam")).alias("mu"), "lam", "contributors")


def pair_moments(observed: DataFrame, *keys: str) -> DataFrame:
    """(keys, i, j, k, mean, ss): draws of each pair with their mean and sum of squares about it."""
    sums = observed.groupBy(*keys, "i", "j").agg(F.count(F.lit(1)).alias("k"), F.avg("m").alias("mean"), F.var_pop("m").alias("v"))
    return sums.select(*keys, "i", "j", "k", "mean", (F.col("v") * F.col("k")).alias("ss"))


def within_variance(observed: DataFrame, *keys: str) -> DataFrame:
    """Pooled variance within pairs of at least two draws; null where no pair repeats."""
    pairs = pair_moments(observed, *keys)
    repeated = F.col("k") >= 2
    return pairs.groupBy(*keys).agg(
        F.count_if(repeated).alias("repeated_pairs"),
        F.sum(F.when(repeated, F.col("k") - 1).otherwise(0)).alias("df"),
        (F.sum(F.when(repeated, F.col("ss"))) / F.sum(F.when(repeated, F.col("k") - 1))).alias("sigma_w2"),
    )


def counterbalance(observed: DataFrame, *keys: str) -> DataFrame:
    """Pairs read in both orders and how many turned: one decisive direction for each order, the first by ``comparison_index``."""
    order = (F.col("a") < F.col("b")).cast("int")
    decisive = observed.filter(F.col("ratio") > 1).withColumns({"lo_first": order, "up": F.signum("m").cast("int")})
    at = F.struct("comparison_index", "delivery_id")
    both = decisive.groupBy(*keys, "i", "j").agg(F.min_by(F.when(order == 1, F.col("up")), F.when(order == 1, at)).alias("f"), F.min_by(F.when(order == 0, F.col("up")), F.when(order == 0, at)).alias("r"))
    both = both.filter(F.col("f").isNotNull() & F.col("r").isNotNull())
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("f") != F.col("r")).alias("flips"))


def order_residual(observed: DataFrame, *keys: str) -> DataFrame:
    """Mean over pairs of |m + m'| in presented coordinates, of the first reading in each order; 0 without position bias."""
    order = F.col("a") < F.col("b")
    at = F.struct("comparison_index", "delivery_id")
    both = observed.groupBy(*keys, "i", "j").agg(F.min_by(F.when(order, F.col("m_first")), F.when(order, at)).alias("f"), F.min_by(F.when(~order, F.col("m_first")), F.when(~order, at)).alias("r"))
    both = both.filter(F.col("f").isNotNull() & F.col("r").isNotNull())
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.abs(F.col("f") + F.col("r"))).alias("order_residual"))


def margins(observed: DataFrame, *keys: str) -> DataFrame:
    """Mean signed log2-ratio of each entity: winners gain, losers lose."""
    both = observed.select(*keys, F.explode(F.array(F.struct(F.col("i").alias("entity_id"), (F.col("m") / math.log(2)).alias("s")), F.struct(F.col("j").alias("entity_id"), (-F.col("m") / math.log(2)).alias("s")))).alias("x"))
    return both.groupBy(*keys, F.col("x.entity_id").alias("entity_id")).agg(F.avg("x.s").alias("margin"), F.count(F.lit(1)).alias("readings"))


def run_accounting(rows: DataFrame, *keys: str) -> DataFrame:
    """Attempts, uses, refusals, cache hits, tokens, nanodollars and models of each run."""
    refused, failed = F.col("refused") == 1, F.col("error") != ""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(~refused & ~failed).alias("used"),
        F.count_if(refused).alias("refused"),
        F.count_if(failed).alias("failed"),
        F.count_if(F.col("cached") == 1).alias("cached"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum("cost_nanodollars"), F.lit(0)).alias("nanodollars"),
        F.when(F.count_distinct("model") > 1, F.concat(F.lit("mixed: "), F.array_join(F.array_sort(F.collect_set("model")), ", "))).otherwise(F.max("model")).alias("models_used"),
    )
