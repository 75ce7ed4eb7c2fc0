"""Readers and sinks: item lists, rendered rankings, traces, packets, landing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACE = T.StructType([
    T.StructField("ts_ms", T.LongType()), T.StructField("run_id", T.StringType()), T.StructField("axis_key", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("comparison_index", T.LongType()), T.StructField("entity_a_id", T.StringType()), T.StructField("entity_b_id", T.StringType()),
    T.StructField("swapped", T.IntegerType()), T.StructField("refused", T.IntegerType()), T.StructField("higher_ranked", T.StringType()),
    T.StructField("ratio", T.DoubleType()), T.StructField("confidence", T.DoubleType()), T.StructField("error", T.StringType()),
])


def read_items(spark: SparkSession, path: str, format: str = "text") -> DataFrame:
    """(entity_id, text) of a list: one item a line, or JSON strings or objects {id, text}."""
    if format == "text":
        rows = spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").alias("text"), F.lit(None).cast("string").alias("id"))
    else:
        rows = spark.read.schema("id string, text string").option("multiLine", True).json(path).select("text", "id")
    # numbered from 0 in file order: each task's offset is the sum of the rows before it, a row for each task
    rows = rows.withColumns({"_at": F.monotonically_increasing_id(), "_part": F.spark_partition_id()})
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_offset"))
    number = F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.join(F.broadcast(offsets), "_part").withColumn("_n", number)
    return rows.select(F.coalesce("id", F.concat(F.lit("item-"), F.lpad(F.col("_n").cast("string"), F.greatest(F.lit(4), F.length(F.col("_n").cast("string"))), F.lit("0")))).alias("entity_id"), "text")


def write_ranking(ranking: DataFrame, path: str, format: str) -> None:
    """As text (one entity a line), json, jsonl or csv, in rank order."""
    ordered = ranking.orderBy("rank")
    if format == "text":
        ordered.select("entity_id").write.mode("overwrite").text(path)
    elif format == "csv":
        ordered.write.mode("overwrite").option("header", True).csv(path)
    else:
        ordered.write.mode("overwrite").json(path)


def append_traces(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_traces(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(TRACE).json(path)


def land(spark: SparkSession, rows: DataFrame, path: str, key: str = "run_id") -> int:
    """Append the runs that aren't there yet; landing a run twice changes nothing.  Returns the rows landed.

    One landing at a time; ``records.land_runs`` keeps two apart.
    """
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(place) and files.globStatus(jvm.org.apache.hadoop.fs.Path(path + "/*.parquet")):
        there = spark.read.parquet(path).select(key).distinct()
        rows = rows.join(there, key, "left_anti")
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    return n


def resume_set(wanted: DataFrame, landed: DataFrame, key: str, least: int) -> DataFrame:
    """Keys of ``wanted`` of which fewer than ``least`` rows are landed."""
    done = landed.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    return wanted.join(done, key, "left_anti")
