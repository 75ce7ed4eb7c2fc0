"""A judge made of arithmetic: readings of planted scores with noise, outliers and refusals, from digests.

The same seed gives the same readings on every run, in any order of rows and in
any engine that has MD5.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.resample import uniform

#: Largest outlier, as a log-ratio; largest reading.
OUTLIER, MOST = 3.0, math.log(26.0)


def normal(*parts: Column) -> Column:
    """A standard normal number from two digests."""
    u = F.greatest(uniform(F.lit("u"), *parts), F.lit(1e-12))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(F.lit("v"), *parts))


def readings(pairs: DataFrame, keys: list[str], sigma: float, outliers: float = 0.0, refusals: float = 0.0, seed: int = 1, ordinal: bool = False, draw: Column | None = None) -> DataFrame:
    """``m`` (log-ratio of i over j) and ``refused`` for pairs (keys, i, j, d), where ``d`` is the true difference.

    Lognormal noise of ``sigma``; a part ``outliers`` of the readings is drawn evenly
    from +-``OUTLIER`` instead; ``ordinal`` keeps the sign alone.
    """
    name = [F.lit(seed), *[F.col(k) for k in keys], F.col("i"), F.col("j"), *([draw] if draw is not None else [])]
    odd = uniform(F.lit("o"), *name) < outliers
    m = F.when(odd, (2 * uniform(F.lit("w"), *name) - 1) * OUTLIER).otherwise(F.col("d") + sigma * normal(*name))
    m = F.greatest(F.least(m, F.lit(MOST)), F.lit(-MOST))
    return pairs.withColumns({"m": F.signum(m) if ordinal else m, "refused": uniform(F.lit("r"), *name) < refusals})
