"""Comparison designs: rings of every set of strides, and what their graphs can tell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stride_sets(spark: SparkSession, sizes: tuple[int, ...]) -> DataFrame:
    """(n, mask): every set of strides of a ring of n; bit s - 1 stands for stride s."""
    rows = spark.createDataFrame([(n,) for n in sizes], "n int")
    return rows.withColumn("mask", F.explode(F.expr("sequence(1, int(pow(2, floor(n / 2))) - 1)")))


def ring_pairs(n: int, strides: list[int]) -> tuple[np.ndarray, np.ndarray]:
    a = np.repeat(np.arange(n), len(strides))
    b = (a + np.tile(strides, n)) % n
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
    return pairs[:, 0], pairs[:, 1]


def atlas(designs: DataFrame) -> DataFrame:
    """(n, mask, edges, triangles, components, cycle_dim, harmonic_dim, fiedler) of each design."""
    from pairloom.plans.solver import components, curl_rank, triangles

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for n, mask in zip(part["n"].tolist(), part["mask"].tolist()):
                i, j = ring_pairs(n, [s for s in range(1, n // 2 + 1) if mask >> (s - 1) & 1])
                own = len(np.unique(components(n, i, j)))
                cycles = len(i) - n + own
                near = np.zeros((n, n))
                near[i, j] = near[j, i] = 1
                value = np.linalg.eigvalsh(np.diag(near.sum(1)) - near)
                rows.append((n, mask, len(i), len(triangles(n, i, j)), own, cycles, cycles - curl_rank(n, i, j, cycles), float(max(value[1], 0.0))))
            yield pd.DataFrame(rows, columns=["n", "mask", "edges", "triangles", "components", "cycle_dim", "harmonic_dim", "fiedler"])

    return designs.mapInPandas(measure, "n int, mask int, edges int, triangles int, components int, cycle_dim int, harmonic_dim int, fiedler double")
