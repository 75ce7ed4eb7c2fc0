"""Numbers written token by token: masses of the tokens' tree, bounds of the mean, and what the draws say beyond them.

A draw writes a direction ('A' or 'B'), whole digits and a tenth; with each token
comes the probability that the provider gave it.  A node's token has the mean
probability of the draws that show it there; a leaf's mass is the product along
its path, and what a node's tokens leave of 1 is that node's cell, whose numbers
are known up to the digits before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest number that the digits can write, and its log.
LARGEST = 999.9
Z = math.log(LARGEST)


def _sign() -> Column:
    return F.when(F.col("direction") == "A", 1.0).otherwise(-1.0)


def leaf_value() -> Column:
    """Signed log of a leaf's number; numbers below 1 count as 1."""
    return _sign() * F.log(F.greatest(F.col("whole") + F.col("part") / 10, F.lit(1.0)))


def _masses(draws: DataFrame, path: list[str], token: str, p: str) -> DataFrame:
    """(path, token, mass, rest): mean probabilities of a node's tokens, scaled down where they exceed 1 together."""
    mean = draws.groupBy(*path, token).agg(F.avg(p).alias("raw"))
    total = mean.groupBy(*path).agg(F.sum("raw").alias("total"))
    x = mean.join(total, path).withColumn("mass", F.col("raw") / F.greatest("total", F.lit(1.0)))
    return x.select(*path, token, "mass", F.greatest(1 - F.col("total"), F.lit(0.0)).alias("rest"))


def tree(draws: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Leaves (keys, direction, whole, part, p) and cells (keys, mass, z_lo, z_hi)."""
    one = _masses(draws, keys, "direction", "p_direction")
    two = _masses(draws, [*keys, "direction"], "whole", "p_whole")
    three = _masses(draws, [*keys, "direction", "whole"], "part", "p_part")
    a = one.select(*keys, "direction", F.col("mass").alias("m1"))
    b = two.select(*keys, "direction", "whole", F.col("mass").alias("m2")).join(a, [*keys, "direction"]).withColumn("m2", F.col("m1") * F.col("m2"))
    leaves = three.join(b, [*keys, "direction", "whole"]).select(*keys, "direction", "whole", "part", (F.col("m2") * F.col("mass")).alias("p"))
    bound = lambda low, high: [F.least(_sign() * low, _sign() * high).alias("z_lo"), F.greatest(_sign() * low, _sign() * high).alias("z_hi")]
    root = one.select(*keys, "rest").distinct().select(*keys, F.col("rest").alias("mass"), F.lit(-Z).alias("z_lo"), F.lit(Z).alias("z_hi"))
    mid = two.select(*keys, "direction", "rest").distinct().join(a, [*keys, "direction"])
    mid = mid.select(*keys, (F.col("rest") * F.col("m1")).alias("mass"), *bound(F.lit(0.0), F.lit(Z)))
    low = three.select(*keys, "direction", "whole", "rest").distinct().join(b.select(*keys, "direction", "whole", "m2"), [*keys, "direction", "whole"])
    at = lambda x: F.log(F.greatest(x, F.lit(1.0)))
    low = low.select(*keys, (F.col("rest") * F.col("m2")).alias("mass"), *bound(at(F.col("whole")), at(F.col("whole") + 0.9)))
    return leaves, root.unionByName(mid).unionByName(low)


def bounds(leaves: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, enumerated, cell_mass, e_lo, e_mid, e_hi): the mean log-ratio, wherever the cells' masses lie."""
    head = leaves.groupBy(*keys).agg(F.sum("p").alias("enumerated"), F.sum(F.col("p") * leaf_value()).alias("e"))
    rest = cells.groupBy(*keys).agg(F.sum("mass").alias("cell_mass"), F.sum(F.col("mass") * F.col("z_lo")).alias("lo"), F.sum(F.col("mass") * F.col("z_hi")).alias("hi"))
    x = head.join(rest, keys)
    gap = F.abs(1 - F.col("enumerated") - F.col("cell_mass"))
    return x.select(*keys, "enumerated", "cell_mass", (F.col("e") + F.col("lo") - gap * Z).alias("e_lo"), (F.col("e") + (F.col("lo") + F.col("hi")) / 2).alias("e_mid"), (F.col("e") + F.col("hi") + gap * Z).alias("e_hi"))


def cross_fit(draws: DataFrame, keys: list[str], first_half: Column) -> DataFrame:
    """(keys, estimate): leaves of the first half of the draws by their masses, the rest of the mass by the other half's draws outside them."""
    leaves, _ = tree(draws.filter(first_half), keys)
    head = leaves.groupBy(*keys).agg(F.sum("p").alias("q"), F.sum(F.col("p") * leaf_value()).alias("e"))
    outside = draws.filter(~first_half).join(leaves.select(*keys, "direction", "whole", "part"), [*keys, "direction", "whole", "part"], "left_anti")
    rest = outside.groupBy(*keys).agg(F.avg(leaf_value()).alias("m"))
    x = head.join(rest, keys, "left")
    return x.select(*keys, (F.col("e") + F.greatest(1 - F.col("q"), F.lit(0.0)) * F.coalesce("m", F.lit(0.0))).alias("estimate"))


def draws_or_frequencies(draws: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, draws, mean, variance) of the draws' numbers alone, for pairs whose tokens came without probabilities; at least two draws."""
    return draws.groupBy(*keys).agg(F.count(F.lit(1)).alias("draws"), F.avg(leaf_value()).alias("mean"), F.var_samp(leaf_value()).alias("variance")).filter("draws >= 2")


def jitter(draws: DataFrame, keys: list[str], token: str, p: str, least: float = 0.01) -> DataFrame:
    """(keys, tokens, jitter_median, jitter_max) of the spread of each token's probability between draws; the median is the upper one."""
    g = draws.groupBy(*keys, token).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean"), (F.max(p) - F.min(p)).alias("spread"))
    g = g.filter((F.col("n") > 1) & (F.col("mean") > least))
    spreads = F.array_sort(F.collect_list("spread"))
    return g.groupBy(*keys).agg(F.count(F.lit(1)).alias("tokens"), F.element_at(spreads, (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int")).alias("jitter_median"), F.max("spread").alias("jitter_max"))
