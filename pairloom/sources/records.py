"""JSON records: judgement runs, pools of entities, landing by commit, and the checks made when they are read.

A record that breaks a rule isn't dropped: it comes back with the rules it
breaks in ``problems``, so that a reader chooses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.incremental import CommittedLoad

RUN = "run_ref string, axis_key string, model string, status string, started_at string, finished_at string, comparisons bigint, refused bigint, cost_nanodollars bigint, entities array<string>, _corrupt string"
POOL = "pool_id string, items array<struct<id: string, text: string, truth: double>>, _corrupt string"
STATUSES = ("running", "finished", "failed")


def _problems(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for broken, name in rules]))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One JSON record a line for each run, with ``problems``; a run_ref that occurs twice is one on every row of it."""
    rows = spark.read.schema(RUN).option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("_id", F.coalesce("run_ref", F.lit("")))
    many = rows.groupBy("_id").agg((F.count(F.lit(1)) > 1).alias("_twice"))
    x = rows.join(many, "_id")
    made = F.coalesce("comparisons", F.lit(0))
    problems = _problems(
        (F.col("_corrupt").isNotNull(), "not JSON"),
        (F.trim(F.col("_id")) == "", "no run_ref"),
        (F.col("_twice") & (F.col("_id") != ""), "run_ref used twice"),
        (~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "unknown status"),
        ((made < 0) | (F.coalesce("refused", F.lit(0)) < 0) | (F.coalesce("refused", F.lit(0)) > made), "counts don't add up"),
        (F.coalesce(F.col("cost_nanodollars") < 0, F.lit(False)), "negative cost"),
        ((F.col("status") == "finished") & F.col("finished_at").isNull(), "finished without an end"),
        (F.size(F.array_distinct(F.coalesce("entities", F.array().cast("array<string>")))) < F.size(F.coalesce("entities", F.array().cast("array<string>"))), "entity listed twice"),
    )
    return x.withColumn("problems", problems).drop("_id", "_twice")


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """(pool_id, place, entity_id, text, truth, problems) of pools of entities, one JSON record a line."""
    rows = spark.read.schema(POOL).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    x = rows.select("pool_id", F.posexplode_outer("items").alias("place", "item"), "_corrupt")
    ids = x.groupBy("pool_id", F.col("item.id").alias("_i")).agg((F.count(F.lit(1)) > 1).alias("_twice"), F.count("item.truth").alias("_truths"))
    y = x.join(ids, x["pool_id"].eqNullSafe(ids["pool_id"]) & F.col("item.id").eqNullSafe(F.col("_i"))).drop(ids["pool_id"])
    problems = _problems(
        (F.col("_corrupt").isNotNull(), "not JSON"),
        (F.coalesce(F.trim("item.id"), F.lit("")) == "", "no id"),
        (F.coalesce(F.trim("item.text"), F.lit("")) == "", "no text"),
        (F.col("_twice") & F.col("item.id").isNotNull(), "id used twice"),
        (F.coalesce(F.isnan("item.truth"), F.lit(False)), "truth isn't a number"),
    )
    return y.select("pool_id", "place", F.col("item.id").alias("entity_id"), F.col("item.text").alias("text"), F.col("item.truth").alias("truth"), problems.alias("problems"))


def land_runs(spark: SparkSession, rows: DataFrame, store: str, key: str = "run_id") -> int:
    """Land the runs that no commit of ``store`` holds, in one commit; of two landings at once the later fails and lands on its next try."""
    load = CommittedLoad(spark, store)
    done = load.commits()
    if done:
        rows = rows.join(load.read().select(key).distinct(), key, "left_anti")
    got = load.run(rows.withColumn("_landing", F.lit(len(done)).cast("long")), "_landing", lambda source, upper, since: source.drop("_landing"))
    return got.rows if got else 0
