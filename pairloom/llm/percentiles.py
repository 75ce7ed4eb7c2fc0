"""Percentiles of very large numeric columns, per group, exact and mergeable.

The state of a day or batch is its run-length form: (group, metric, value,
rows).  States combine by adding the rows of equal values, so any split of the
data gives the same result, and the error bound is zero.  Percentiles come from
one distributed sort of the combined state with counts per task: offsets place
each task in each group, the target positions are located, only the tasks' files
that hold one are read again, and the two neighbouring order statistics are
interpolated as position ``p * (n - 1)``.

Defined cases: null and NaN values aren't numbers and don't count; a group of
which no value counts has no row; a null group is a group; ties and repeated
rows count as often as they occur; infinite values sort at the ends.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.ordered import BROADCAST_ROWS, _on_groups, sorted_counts
from pairloom.session import materialise

PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def summarise(rows: DataFrame, groups: list[str], metrics: list[str]) -> DataFrame:
    """State of ``rows``: (groups, metric, value, n)."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    long = rows.select(*groups, F.explode(pairs).alias("_p")).select(*groups, "_p.metric", "_p.value")
    long = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.groupBy(*groups, "metric", "value").agg(F.count(F.lit(1)).alias("n"))


def merge(states: list[DataFrame], groups: list[str]) -> DataFrame:
    """One state of several; also of one state over more groups than wanted, such as days."""
    columns = [*groups, "metric", "value"]
    together = reduce(DataFrame.unionByName, [s.select(*columns, "n") for s in states])
    return together.groupBy(*columns).agg(F.sum("n").alias("n"))


def percentiles(state: DataFrame, groups: list[str], points: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """(groups, metric, n, p, value) of a merged state."""
    by = [*groups, "metric"]
    rows, offsets = sorted_counts(state.select(*by, "value", "n"), by, ["value"])
    here = offsets.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in points])))
    position = F.col("p") * (F.col("total") - 1)
    here = here.withColumns({"at": position, "low": F.floor(position), "high": F.ceil(position)})
    # each task's own share of every group ends where the next one's begins
    sizes = rows.groupBy("part", *by).agg(F.sum("n").alias("here"))
    small = F.broadcast(sizes) if offsets.count() <= BROADCAST_ROWS else sizes
    targets = here.join(small, _on_groups(here, small, by)).select(here["part"], *[here[b] for b in by], "offset", "total", "p", "at", "low", "high", "here")
    targets = targets.filter((F.col("high") >= F.col("offset")) & (F.col("low") < F.col("offset") + F.col("here")))
    few = F.broadcast(targets) if offsets.count() * len(points) <= BROADCAST_ROWS else targets
    start = F.col("offset") + F.col("within")
    holds = lambda k: (F.col(k) >= start) & (F.col(k) < start + F.col("n"))
    found = rows.join(few, _on_groups(rows, few, by)).filter(holds("low") | holds("high"))
    ends = found.groupBy(*[few[b] for b in by], "p").agg(F.first("total").alias("n"), F.first("at").alias("at"), F.min("value").alias("a"), F.max("value").alias("b"))
    share = F.col("at") - F.floor("at")
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * share)
    return ends.select(*by, "n", "p", value.alias("value"))


def p5_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Of cost and output tokens by model: for each day, and (day null) for the whole from the days' states."""
    rows = spark.read.parquet(f"{sf}/comparisons.parquet").withColumn("day", F.date_format("landed_at", "yyyy-MM-dd"))
    days = materialise(summarise(rows, ["model", "day"], ["cost_nanodollars", "output_tokens"]), "percentile-states")
    whole = percentiles(merge([days], ["model"]), ["model"]).withColumn("day", F.lit(None).cast("string"))
    out = percentiles(days, ["model", "day"]).unionByName(whole)
    return out.select("model", "day", "metric", "n", "p", F.round("value", 6).alias("value"))


QUERIES = {"p5_percentiles": p5_percentiles}
_VALUES = """(select model, strftime(landed_at, '%Y-%m-%d') as day, 'cost_nanodollars' as metric, cost_nanodollars::double as x from comparisons
              union all select model, strftime(landed_at, '%Y-%m-%d'), 'output_tokens', output_tokens::double from comparisons)"""
# DuckDB wants a constant percentile
SQL = {
    "p5_percentiles": " union all ".join(
        f"select model, {day} as day, metric, count(*) as n, {p}::double as p, round(quantile_cont(x, {p}), 6) as value from {_VALUES} where x is not null group by model, {by}metric"
        for p in PERCENTILES
        for day, by in (("day", "day, "), ("null::varchar", ""))
    )
}
