"""Evidence arriving as files: fused edges kept up to date, each batch applied once.

The fused state is a sum, so arrival order and lateness don't matter and no
watermark is needed.  Every batch is written under its own number, and a batch
that is replayed after a failure overwrites itself; the state is the sum over
the numbers, compacted now and then by whoever reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairloom.sources.files import read_traces


def trace_observations(traces: DataFrame) -> DataFrame:
    """(axis_key, i, j, m) of the usable traces."""
    good = traces.filter((F.coalesce("refused", F.lit(0)) == 0) & F.col("higher_ranked").isin("A", "B") & (F.col("ratio") > 0) & (F.col("entity_a_id") != F.col("entity_b_id")))
    up = (F.col("higher_ranked") == "A") == (F.col("entity_a_id") < F.col("entity_b_id"))
    return good.select("axis_key", F.least("entity_a_id", "entity_b_id").alias("i"), F.greatest("entity_a_id", "entity_b_id").alias("j"), (F.when(up, 1.0).otherwise(-1.0) * F.log("ratio")).alias("m"))


def start_fusing(spark: SparkSession, traces: str, state: str, checkpoint: str) -> StreamingQuery:
    """Fuse new trace files into ``state`` until what is there is taken."""

    def apply(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("axis_key", "i", "j").agg(F.sum("m").alias("weighted"), F.count(F.lit(1)).cast("double").alias("lam"))
        sums.write.mode("overwrite").parquet(f"{state}/batch={number}")

    stream = trace_observations(read_traces(spark, traces, stream=True))
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fused_state(spark: SparkSession, state: str) -> DataFrame:
    sums = spark.read.parquet(state).groupBy("axis_key", "i", "j").agg(F.sum("weighted").alias("weighted"), F.sum("lam").alias("lam"))
    return sums.select("axis_key", "i", "j", (F.col("weighted") / F.col("lam")).alias("mu"), "lam")


def windowed_events(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts and sums of an event stream by window and type, late rows waited for."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
