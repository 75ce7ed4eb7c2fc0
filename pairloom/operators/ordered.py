"""Positions of values in the sorted order of their group, without a group in one task.

The distinct values are range-partitioned and sorted once, over all groups
together, so a group that holds a third of all rows is spread over many tasks.
Each task counts what it holds of each group; the counts' running sums give
each task its offset in each group, and a value's position is that offset plus
the running count within the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.session import default_parallelism, materialise

#: Rows of the table of offsets (tasks + groups) up to which it is broadcast; about 100 bytes each.
BROADCAST_ROWS = 100_000
#: Copies of the smaller side of a join where a key may be hot.
SALTS = 16


def hot_join(rows: DataFrame, small: DataFrame, on: list[str], most: int | None = None) -> DataFrame:
    """Inner join on keys (nulls equal) of which one may hold a third of ``rows``; ``small`` has a row for each key.

    Up to ``BROADCAST_ROWS`` keys are counted and broadcast.  Beyond, the session's adaptive execution splits a hot key's rows over
    tasks; where that is switched off, ``small`` is copied ``SALTS`` times, so that a hot key is joined in as many tasks.
    ``most``: that many keys at most, if it's known.
    """
    kept = [c for c in small.columns if c not in on]
    right = small.select(*[F.col(c).alias(f"_on_{c}") for c in on], *kept)
    match = lambda r: reduce(and_, [rows[c].eqNullSafe(r[f"_on_{c}"]) for c in on])
    if (small.count() if most is None else most) <= BROADCAST_ROWS:
        right = F.broadcast(right)
        return rows.join(right, match(right)).select(*[rows[c] for c in rows.columns], *[right[c] for c in kept])
    conf = rows.sparkSession.conf
    if all(conf.get(f"spark.sql.adaptive.{c}", "true") == "true" for c in ("enabled", "skewJoin.enabled")):
        return rows.join(right, match(right)).select(*[rows[c] for c in rows.columns], *[right[c] for c in kept])
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = [F.col(c) for c in rows.columns if c not in on] or [F.monotonically_increasing_id()]
    left = rows.withColumn("_salt_of", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    by = reduce(and_, [left[c].eqNullSafe(right[f"_on_{c}"]) for c in on])
    return left.join(right, by & (left["_salt_of"] == right["_salt"])).select(*[left[c] for c in rows.columns], *[right[c] for c in kept])


def sorted_counts(values: DataFrame, groups: list[str], order: list[str], count: str = "n") -> tuple[DataFrame, DataFrame]:
    """The distinct (groups, order, count) rows as sorted in tasks, and each task's offset.

    First: the rows with ``part`` and ``within`` (the count before the row in its
    task and group).  Second: (part, groups, offset, total).
    """
    columns = values.columns
    parts = default_parallelism(values.sparkSession)
    by = [*groups, *order]
    # one column tells where a group begins, whatever the groups' types
    ranged = values.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    ranged = ranged.withColumn("part", F.spark_partition_id()).withColumn("_group", F.xxhash64(*groups, F.lit(0)))
    at = ranged.columns.index(count), ranged.columns.index("_group")

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(at[0]).to_numpy(zero_copy_only=False).astype(np.int64)
            g = batch.column(at[1]).to_numpy(zero_copy_only=False)
            before = np.cumsum(n) - n
            first = np.concatenate(([True], g[1:] != g[:-1]))
            base = before[np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))]
            within = before - base
            if last is not None and g[0] == last:
                lead = np.flatnonzero(g != g[0])
                within[: lead[0] if len(lead) else len(g)] += carried
            last, carried = g[-1], int(within[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(within)], [*batch.schema.names, "within"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema), "within long"])
    kept = materialise(ranged.mapInArrow(running, schema).drop("_group"), "ordered")
    counts = kept.groupBy("part", *groups).agg(F.sum(count).alias("here"))
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    offsets = counts.select(
        "part",
        *groups,
        (F.sum("here").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("here")).alias("offset"),
        F.sum("here").over(w).alias("total"),
    )
    return kept.select(*columns, "part", "within"), materialise(offsets, "ordered-offsets")


def _on_groups(left: DataFrame, right: DataFrame, groups: list[str]) -> Column:
    on = left["part"] == right["part"]
    for g in groups:
        on = on & left[g].eqNullSafe(right[g])
    return on


def positions(values: DataFrame, groups: list[str], order: list[str], count: str = "n") -> DataFrame:
    """``values`` with ``before`` (rows of the group that sort before) and ``total`` (rows of the group)."""
    rows, offsets = sorted_counts(values, groups, order, count)
    small = F.broadcast(offsets) if offsets.count() <= BROADCAST_ROWS else offsets
    joined = rows.join(small, _on_groups(rows, small, groups))
    return joined.select(*[rows[c] for c in values.columns], (F.col("within") + F.col("offset")).alias("before"), F.col("total"))


def medians(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, median) by one distributed sort; nulls and NaN don't count."""
    good = rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("_v", F.col(value).cast("double"))
    placed = positions(good.groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("n")), groups, ["_v"])
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
    return placed.filter(holds(low) | holds(high)).groupBy(*groups).agg(((F.min("_v") + F.max("_v")) / 2).alias("median"))
