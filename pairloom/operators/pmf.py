"""Answer distributions as long rows (keys, atom, p), and their algebra.

An atom is a signed rung of the ratio ladder: 0 parity, k > 0 the first side by
rung k, k < 0 the other side.  Its value is the signed log of the rung.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The 25 rungs of the letter ladder.
LADDER = (1.06, 1.17, 1.33, 1.56, 1.85, 2.25, 2.78, 3.49, 4.45, 5.74, 7.51, 9.95, 13.3, 18.1, 24.8, 34.4, 48.1, 68.1, 97.2, 140.0, 204.0, 299.0, 444.0, 663.0, 1000.0)
LOGS = (0.0, *(math.log(r) for r in LADDER))


def atom_value(atom: Column) -> Column:
    logs = F.array(*[F.lit(x) for x in LOGS])
    return F.signum(atom.cast("double")) * F.element_at(logs, F.abs(atom) + 1)


def on_ladder(m: Column) -> Column:
    """array of struct(atom, p): one or two neighbouring atoms whose mean is ``m``; the ends saturate."""
    logs = F.array(*[F.lit(x) for x in LOGS])
    size, side = F.abs(m), F.when(m < 0, -1).otherwise(1)
    below = F.size(F.filter(logs, lambda x: x < size)) - 1
    low = F.greatest(below, F.lit(0))
    up = F.least(low + 1, F.lit(len(LADDER)))
    a, b = F.element_at(logs, low + 1), F.element_at(logs, up + 1)
    share = F.when(low == up, 1.0).otherwise((size - a) / (b - a))
    pair = F.array(F.struct((side * low).alias("atom"), (1 - share).alias("p")), F.struct((side * up).alias("atom"), share.alias("p")))
    full = F.array(F.struct((side * len(LADDER)).alias("atom"), F.lit(1.0).alias("p")))
    return F.filter(F.when(size >= LOGS[-1], full).otherwise(pair), lambda x: x["p"] > 0)


def normalised(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Masses merged by atom and divided by their sum; negative or NaN masses and empty groups are left out."""
    good = rows.filter((F.col("p") >= 0) & ~F.isnan("p"))
    merged = good.groupBy(*keys, "atom").agg(F.sum("p").alias("p"))
    total = merged.groupBy(*keys).agg(F.sum("p").alias("_t")).filter("_t > 0")
    return merged.join(total, keys).select(*keys, "atom", (F.col("p") / F.col("_t")).alias("p"))


def from_readings(observed: DataFrame, keys: list[str]) -> DataFrame:
    """The readings' empirical distribution on the ladder."""
    rows = observed.select(*keys, F.explode(on_ladder(F.col("m"))).alias("x")).select(*keys, "x.atom", "x.p")
    return normalised(rows, keys)


def summary(pmf: DataFrame, keys: list[str]) -> DataFrame:
    """Moments, direction, entropy (nats) and the likeliest atom."""
    v, p = atom_value(F.col("atom")), F.col("p")
    x = pmf.withColumn("v", v)
    return x.groupBy(*keys).agg(
        F.sum(p * F.col("v")).alias("mean"),
        F.sum(p * F.col("v") * F.col("v")).alias("second"),
        F.sum(F.when(F.col("atom") > 0, p).otherwise(0.0)).alias("p_first"),
        F.sum(F.when(F.col("atom") == 0, p).otherwise(0.0)).alias("p_equal"),
        F.sum(F.when(F.col("atom") < 0, p).otherwise(0.0)).alias("p_second"),
        F.sum(F.when(p > 0, -p * F.log("p")).otherwise(0.0)).alias("entropy"),
        F.max_by("atom", F.struct(F.round("p", 9), -F.col("atom"))).alias("top"),
    )


def reflected(pmf: DataFrame) -> DataFrame:
    """Sides swapped."""
    return pmf.withColumn("atom", -F.col("atom"))


def mixture(parts: DataFrame, keys: list[str], weight: str) -> DataFrame:
    return normalised(parts.withColumn("p", F.col("p") * F.col(weight)), keys)


def jensen_shannon(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Divergence in bits on the joint support."""
    both = a.select(*keys, "atom", F.col("p").alias("pa")).join(b.select(*keys, "atom", F.col("p").alias("pb")), [*keys, "atom"], "full").fillna(0.0, ["pa", "pb"])
    mid = (F.col("pa") + F.col("pb")) / 2
    part = lambda p: F.when(p > 0, p * F.log2(p / mid)).otherwise(0.0)
    return both.groupBy(*keys).agg(F.sum((part(F.col("pa")) + part(F.col("pb"))) / 2).alias("jsd"))


def convolved(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, p) of the sum of two independent log-ratios; at most 51 x 51 atoms each."""
    x = a.select(*keys, atom_value(F.col("atom")).alias("va"), F.col("p").alias("pa"))
    y = b.select(*keys, atom_value(F.col("atom")).alias("vb"), F.col("p").alias("pb"))
    s = x.join(y, keys).withColumn("value", F.round(F.col("va") + F.col("vb"), 9) + F.lit(0.0))
    return s.groupBy(*keys, "value").agg(F.sum(F.col("pa") * F.col("pb")).alias("p"))


def compressed(dist: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Neighbouring values merged into at most ``most`` points of their mean value."""
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    chunk = F.floor((F.row_number().over(w.orderBy("value")) - 1) / F.ceil(n / most))
    x = dist.withColumn("_c", chunk)
    return x.groupBy(*keys, "_c").agg((F.sum(F.col("value") * F.col("p")) / F.sum("p")).alias("value"), F.sum("p").alias("p")).drop("_c")


def leaf_shares(draws: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, direction, whole, part, p, n): each number's share of the n draws that wrote numbers."""
    total = draws.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    leaf = draws.groupBy(*keys, "direction", "whole", "part").agg(F.count(F.lit(1)).alias("c"))
    return leaf.join(total, keys).select(*keys, "direction", "whole", "part", (F.col("c") / F.col("n")).alias("p"), "n")


def horvitz_thompson(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """Mean size of the log-ratio from the distinct leaves seen in n draws, each weighed by its chance to be seen."""
    h = F.log(F.greatest(F.col("whole") + F.col("part") / 10, F.lit(1.0)))
    return leaves.groupBy(*keys).agg(F.sum(F.col("p") * h / (1 - F.pow(1 - F.col("p"), F.col("n")))).alias("estimate"))
