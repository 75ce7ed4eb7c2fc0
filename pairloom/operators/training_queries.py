"""p1 and p3 over the landed tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.keys import clean_key
from pairloom.operators.dedup import deduplicate_files
from pairloom.operators.incremental import CommittedLoad, load_watermarks, watermarks_in_sequence
from pairloom.session import scratch_dir


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """delivery_id of the records that the next load takes: it adopts the log's watermarks, and commits the whole records."""
    path = f"{sf}/comparisons.parquet"
    comparisons, log = spark.read.parquet(path), spark.read.parquet(f"{sf}/load_log.parquet")
    load = CommittedLoad(spark, scratch_dir(spark, "next-load"))
    load.adopt(watermarks_in_sequence(comparisons, load_watermarks(log), clean_key("run_id")))
    if load.run_changes(path) is None:
        return comparisons.select("delivery_id").limit(0)
    return load.read().select("delivery_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """delivery_id of the rows that a later or earlier delivery replaces."""
    return deduplicate_files(spark, f"{sf}/comparisons.parquet", columns=["delivery_id"], deleted=True)


def p3_deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    """The whole wide table with one row for each identifier.

    A ratio that isn't a number is told by ``ratio_is_nan`` and null in ``ratio``, since NaN equals nothing in a comparison of results.
    """
    kept = deduplicate_files(spark, f"{sf}/comparisons.parquet")
    nan = F.coalesce(F.isnan("ratio"), F.lit(False))
    return kept.withColumn("ratio_is_nan", nan).withColumn("ratio", F.when(~nan, F.col("ratio")))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_deduplicated": p3_deduplicated}

_CURRENT = """
    row_number() over (partition by lower(trim(run_id)), comparison_index, lower(trim(entity_a_hash)), lower(trim(entity_b_hash))
                       order by observed_at desc, delivery_id)
"""

SQL = {
    "p1_found": f"""
        with ranked as (select *, {_CURRENT} as rn from comparisons),
        marks as (select lower(trim(run_id)) as run, max(read_to) as read_to from load_log where status = 'succeeded' group by 1)
        select r.delivery_id from ranked r left join marks m on lower(trim(r.run_id)) = m.run
        where r.rn = 1 and (m.read_to is null or r.landed_at > m.read_to)""",
    "p3_found": f"select delivery_id from (select delivery_id, {_CURRENT} as rn from comparisons) where rn > 1",
    "p3_deduplicated": f"select * exclude (rn) replace (case when not isnan(ratio) then ratio end as ratio), coalesce(isnan(ratio), false) as ratio_is_nan from (select *, {_CURRENT} as rn from comparisons) where rn = 1",
}
