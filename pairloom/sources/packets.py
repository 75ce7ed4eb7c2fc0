"""Judgement packets: canonical form, content id, and their merge as a grow-only set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.evidence import fuse


def packets_of(observed: DataFrame) -> DataFrame:
    """One packet for each run, axis and judge: entities with hashes, observations, content id.

    The canonical form sorts entities by id and observations by pair and value,
    so the id depends on the content alone.
    """
    row = F.struct("i", "j", "m")
    p = observed.groupBy("run", "axis_key", "model").agg(F.array_sort(F.collect_list(row)).alias("observations"))
    entities = F.array_sort(F.array_distinct(F.flatten(F.transform("observations", lambda o: F.array(o["i"], o["j"])))))
    p = p.withColumn("entities", entities)
    return p.withColumn("packet_id", F.sha2(F.to_json(F.struct("axis_key", "model", "entities", "observations")), 256))


def merge(packets: DataFrame) -> DataFrame:
    """Fused edges of a set of packets; redelivered packets count once, distinct ones that overlap count twice."""
    once = packets.dropDuplicates(["packet_id"])
    rows = once.select("axis_key", "model", F.explode("observations").alias("o")).select("axis_key", "model", "o.i", "o.j", "o.m")
    return fuse(rows, "axis_key")


def conflicts(entities: DataFrame, id: str = "entity_id", content: str = "entity_hash") -> DataFrame:
    """Ids under which different contents were sent: such packets can't be merged."""
    return entities.groupBy(id).agg(F.count_distinct(content).alias("contents")).filter("contents > 1")
