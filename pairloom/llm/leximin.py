"""One ranking from several differently-scaled scores, by leximin.

Every axis is turned into percentiles (mid-rank of equal scores), so neither
its unit nor its spread nor its shape counts.  An entity's vector of percentiles
is sorted ascending and the vectors are compared lexicographically: the weaker
of the two weakest scores loses, and only equal weakest scores are passed over,
so a strong score can't mask a weak one.

Defined cases: null and NaN scores aren't scores; rows repeated for a run,
entity and axis count once, the latest; several runs of an entity on an axis
are averaged as percentiles; an axis without a score counts as ``missing``
(one half: neither strong nor weak); an entity without any score isn't ranked;
equal vectors share a rank; null ids are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.keys import clean_key
from pairloom.operators.ordered import hot_join, positions
from pairloom.session import materialise

#: Percentile that stands for an axis on which an entity has no score.
MISSING = 0.5


def axis_percentiles(scores: DataFrame, value: str = "latent_mean") -> DataFrame:
    """(entity_id, axis_key, percentile): averaged over the runs that scored the entity on the axis."""
    good = scores.filter(F.col(value).isNotNull() & ~F.isnan(value) & F.col("entity_id").isNotNull() & F.col("axis_key").isNotNull())
    one = good.groupBy(clean_key("run_id").alias("run"), "entity_id", "axis_key").agg(F.max(F.struct(F.col("scored_at").alias("t"), F.col(value).alias("v"))).alias("_s"))
    one = one.select("entity_id", "axis_key", F.col("_s.v").alias("value"))
    counts = one.groupBy("axis_key", "value").agg(F.count(F.lit(1)).alias("n"))
    placed = positions(counts, ["axis_key"], ["value"])
    placed = placed.select("axis_key", "value", ((F.col("before") + F.col("n") / 2) / F.col("total")).alias("p"))
    # an axis of few distinct values has hot keys
    return hot_join(one, materialise(placed, "percentiles"), ["axis_key", "value"]).groupBy("entity_id", "axis_key").agg(F.avg("p").alias("percentile"))


def leximin(percentiles: DataFrame, axes: int, missing: float = MISSING) -> DataFrame:
    """(entity_id, rank, axes_scored, weakest, vector), rank 1 the best."""
    grouped = percentiles.groupBy("entity_id").agg(F.collect_list(F.round("percentile", 9)).alias("own"))
    padded = F.concat("own", F.array_repeat(F.lit(float(missing)), F.lit(axes) - F.size("own")))
    vectors = grouped.select("entity_id", F.size("own").alias("axes_scored"), F.array_sort(padded).alias("vector"))
    counts = vectors.groupBy("vector").agg(F.count(F.lit(1)).alias("n"))
    placed = positions(counts, [], ["vector"])
    ranked = placed.select("vector", (F.col("total") - F.col("before") - F.col("n") + 1).alias("rank"))
    return vectors.join(ranked, "vector").select("entity_id", "rank", "axes_scored", F.element_at("vector", 1).alias("weakest"), "vector")


def p4_leximin(spark: SparkSession, sf: str) -> DataFrame:
    scores = spark.read.parquet(f"{sf}/scores.parquet")
    axes = spark.read.parquet(f"{sf}/axes.parquet").select("axis_key").distinct().count()
    ranked = leximin(axis_percentiles(scores), axes)
    return ranked.withColumn("vector", F.array_join(F.transform("vector", lambda x: F.format_number(x, 6)), " "))


QUERIES = {"p4_leximin": p4_leximin}
SQL = {
    "p4_leximin": """
        with one as (
            select entity_id, axis_key, latent_mean as v from scores
            where latent_mean is not null and not isnan(latent_mean)
            qualify row_number() over (partition by lower(trim(run_id)), entity_id, axis_key order by scored_at desc, latent_mean desc) = 1),
        counts as (select axis_key, v, count(*) as n from one group by all),
        placed as (select axis_key, v, (sum(n) over (partition by axis_key order by v) - n / 2) / sum(n) over (partition by axis_key) as p from counts),
        each as (select entity_id, axis_key, round(avg(p), 9) as p from one join placed using (axis_key, v) group by all),
        vec as (select entity_id, count(*) as k, list_sort(list_concat(list(p), list_transform(range((select count(*) from axes) - count(*)), lambda i: 0.5::double))) as vector from each group by 1)
        select entity_id, rank() over (order by vector desc) as rank, k as axes_scored, vector[1] as weakest,
               array_to_string(list_transform(vector, lambda x: printf('%.6f', x)), ' ') as vector
        from vec"""
}
