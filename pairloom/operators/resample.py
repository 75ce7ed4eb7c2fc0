"""Resampling that needs no draw of rows: each cluster gets a Poisson(1) weight in each replicate, from a digest.

The weights are the same on every run and in any engine that has MD5, and a
replicate is a weighted sum, so clusters are reduced before they are shuffled
and one key may hold any part of the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chances that a Poisson(1) number is at most 0, 1, ... 8.
CUMULATED = tuple(sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(9))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the parts' digest."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def poisson_weight(*parts: Column) -> Column:
    u = uniform(*parts)
    total = F.lit(0)
    for c in CUMULATED:
        total = total + (u >= F.lit(c)).cast("int")
    return total


def bootstrap_means(clusters: DataFrame, keys: list[str], cluster: str, total: str, count: str, replicates: int = 200) -> DataFrame:
    """(keys, low, mid, high): 2.5, 50 and 97.5 % of the mean (sum of ``total`` over sum of ``count``) when whole clusters are drawn with replacement.

    ``clusters`` has a row for each cluster; a replicate in which no cluster is drawn doesn't count.
    """
    r = clusters.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    w = poisson_weight(*[F.col(k) for k in keys], F.col(cluster), F.col("replicate"))
    means = r.groupBy(*keys, "replicate").agg((F.sum(w * F.col(total)) / F.nullif(F.sum(w * F.col(count)), F.lit(0.0))).alias("mean"))
    q = means.filter("mean is not null").groupBy(*keys).agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"))
    return q.select(*keys, *[F.element_at("q", k + 1).alias(c) for k, c in enumerate(("low", "mid", "high"))])
