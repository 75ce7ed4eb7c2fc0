"""The pairwise cache as a table: key, lookup, upsert, export and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.ordered import positions
from pairloom.operators.rowlevel import length_prefixed_digest

KEY_PARTS = ("model", "template_slug", "template_hash", "axis_key", "axis_prompt_hash", "entity_a_hash", "entity_b_hash", "swapped", "temperature")


def cache_key() -> Column:
    return length_prefixed_digest(*[F.col(c) for c in KEY_PARTS])


def upsert(cache: DataFrame | None, rows: DataFrame, at: str = "observed_at") -> DataFrame:
    """One entry for each key: first and last time, hits (uses after the first), and the latest judgement."""
    new = rows.select(cache_key().alias("key_hash"), F.col(at).alias("created_at"), F.col(at).alias("updated_at"), F.lit(1).alias("uses"), "higher_ranked", "ratio")
    both = new if cache is None else cache.select("key_hash", "created_at", "updated_at", (F.col("hit_count") + 1).alias("uses"), "higher_ranked", "ratio").unionByName(new)
    latest = F.max(F.struct("updated_at", "higher_ranked", "ratio"))
    g = both.groupBy("key_hash").agg(F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), (F.sum("uses") - 1).alias("hit_count"), latest.alias("x"))
    return g.select("key_hash", "created_at", "updated_at", "hit_count", F.col("x.higher_ranked").alias("higher_ranked"), F.col("x.ratio").alias("ratio"))


def lookup(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached judgement, misses) of requests that have the key's parts."""
    keyed = requests.withColumn("key_hash", cache_key())
    return keyed.join(cache.select("key_hash", F.col("higher_ranked").alias("cached_side"), F.col("ratio").alias("cached_ratio")), "key_hash"), keyed.join(cache, "key_hash", "left_anti")


def prune(cache: DataFrame, oldest, keep: int) -> DataFrame:
    """Entries updated since ``oldest``, and of those the newest ``keep`` (ties by key), without a global sort in one task."""
    young = cache.filter(F.col("updated_at") >= F.lit(oldest)) if oldest is not None else cache
    counts = young.groupBy("updated_at").agg(F.count(F.lit(1)).alias("n"))
    placed = positions(counts, [], ["updated_at"]).select("updated_at", (F.col("total") - F.col("before") - F.col("n")).alias("newer"), "n")
    at_edge = placed.filter((F.col("newer") < keep))
    joined = young.join(at_edge, "updated_at")
    order = Window.partitionBy("updated_at").orderBy("key_hash")
    return joined.withColumn("_k", F.row_number().over(order)).filter(F.col("newer") + F.col("_k") <= keep).drop("_k", "newer", "n")


def export(cache: DataFrame, path: str) -> None:
    cache.write.mode("overwrite").json(path)
