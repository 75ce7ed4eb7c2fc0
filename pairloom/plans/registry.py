"""Where the core's queries and their SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is DuckDB's form of it."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: The current comparisons, in SQL; ``run``, ``ah``, ``bh`` are the cleaned keys.
CUR = """cur as (
    select *, lower(trim(run_id)) as run, lower(trim(entity_a_hash)) as ah, lower(trim(entity_b_hash)) as bh from comparisons
    qualify row_number() over (partition by lower(trim(run_id)), comparison_index, lower(trim(entity_a_hash)), lower(trim(entity_b_hash))
                               order by observed_at desc, delivery_id) = 1)"""
#: Sanitised observations: m is the log-ratio of i over j, clamped to +-10.
OBS = (
    CUR
    + """, obs as (
    select run, lens, axis_key, model, entity_a_id as a, entity_b_id as b, least(entity_a_id, entity_b_id) as i, greatest(entity_a_id, entity_b_id) as j,
           greatest(least((case when (higher_ranked = 'A') = (entity_a_id < entity_b_id) then 1 else -1 end) * ln(ratio), 10.0::double), -10.0::double) as m,
           case when higher_ranked = 'A' then 1 else -1 end * ln(greatest(ratio, 1)) as m_first,
           ratio, confidence, swapped, cached, comparison_index, delivery_id, observed_at, template_slug, higher_ranked
    from cur where refused = 0 and error = '' and higher_ranked in ('A', 'B') and entity_a_id <> entity_b_id
      and ratio is not null and not isnan(ratio) and not isinf(ratio) and ratio > 0)"""
)
#: Fused edges of an axis over all models.
EDGES = OBS + ", edges as (select axis_key, i, j, sum(m) / count(*) as mu, count(*)::double as lam from obs group by 1, 2, 3)"
