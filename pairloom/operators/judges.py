"""Judges against each other: portfolio, transmissibility, explanation, network priorities, probit."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.ranking import spearman


def judge_correlation(latents: DataFrame, keys: list[str], judge: str = "model", value: str = "s", least: int = 3) -> DataFrame:
    """(keys, judge_a, judge_b, n, r) over the entities that both judged."""
    a = latents.select(*keys, "entity_id", F.col(judge).alias("judge_a"), F.col(value).alias("x"))
    b = latents.select(*keys, "entity_id", F.col(judge).alias("judge_b"), F.col(value).alias("y"))
    n = F.count(F.lit(1))
    ok = (n >= least) & (F.stddev_pop("x") > 1e-9) & (F.stddev_pop("y") > 1e-9)
    return a.join(b, [*keys, "entity_id"]).filter("judge_a < judge_b").groupBy(*keys, "judge_a", "judge_b").agg(n.alias("n"), F.when(ok, F.corr("x", "y")).alias("r"))


# Least correlation that a triad may divide by, largest part of a judge's variance that the consensus may explain,
# least variance of a judge's own error, and what keeps the errors' inverse finite.
LEAST_DIVISOR, MOST_SHARED, LEAST_ERROR, RIDGE = 0.05, 0.998, 1e-3, 1e-6


def consensus_loadings(r: np.ndarray) -> np.ndarray:
    """Correlation of each judge with the consensus: r_ij = l_i l_j gives l_i^2 = r_ij r_ik / r_jk for every triad; the upper median of them."""
    k = len(r)
    if k == 2:
        return np.full(2, math.sqrt(max(r[0, 1], 0.0)))
    usable = np.triu(np.abs(r) >= LEAST_DIVISOR, 1)
    out = np.zeros(k)
    for i in range(k):
        own = usable.copy()
        own[i] = own[:, i] = False
        squares = np.clip(np.outer(r[i], r[i])[own] / r[own], 0.0, MOST_SHARED)
        if len(squares):
            out[i] = math.sqrt(np.partition(squares, len(squares) // 2)[len(squares) // 2])
    return out


def error_covariance(r: np.ndarray, load: np.ndarray) -> np.ndarray:
    """What the consensus leaves of the correlations, as the nearest matrix whose eigenvalues aren't below ``LEAST_ERROR``."""
    rest = r - np.outer(load, load)
    np.fill_diagonal(rest, np.maximum(1 - load**2, LEAST_ERROR))
    value, vector = np.linalg.eigh(rest)
    return (vector * np.maximum(value, LEAST_ERROR)) @ vector.T


def portfolio(names: list[str], r: np.ndarray) -> pd.DataFrame:
    """One-factor view of the judges' correlations: loading on the consensus, weight, and what each adds.

    With the errors' precision M and v = M l, all judges together tell l'Ml of the
    consensus, the best weights are in proportion to v, and without judge i they
    tell v_i^2 / M_ii less: one inverse serves all.
    """
    load = consensus_loadings(r)
    error = error_covariance(r, load)
    precision = np.linalg.inv(error + RIDGE * np.eye(len(r)))
    pull = precision @ load
    total = pull.sum()
    weight = pull / total if abs(total) > 1e-12 else np.full(len(r), 1 / len(r))
    scale = np.sqrt(np.diag(error))
    own = np.maximum(np.linalg.eigvalsh(np.clip(error / np.outer(scale, scale), -1, 1)), 0)
    shared = np.maximum(np.linalg.eigvalsh(r), 0)
    return pd.DataFrame({"judge": names, "loading": load, "weight": weight, "marginal_information": pull**2 / np.diag(precision), "consensus_share": shared.max() / shared.sum(), "error_sources": own.sum() ** 2 / (own**2).sum()})


def canonize(pair_rho: DataFrame, keys: list[str]) -> DataFrame:
    """Mean agreement of the judge pairs, and the largest."""
    return pair_rho.groupBy(*keys).agg(F.count("r").alias("judge_pairs"), F.avg("r").alias("transmissibility"), F.max(F.abs("r")).alias("redundancy"))


def canonicality(latents: DataFrame, axis: str = "axis_key", judge: str = "model", value: str = "s") -> DataFrame:
    """(axis, judge_pairs, transmissibility, signal, redundancy) of each axis.

    Transmissibility is the mean Spearman of the judge pairs, signal the mean of the
    judges' population standard deviations, and redundancy the largest |rho| with an
    axis accepted before, as the first judge by name sees both.  Axes are accepted in
    the order of transmissibility, the best first; it has no redundancy.
    """
    x = latents.select(F.col(axis).alias("axis"), F.col(judge).alias("judge"), "entity_id", F.col(value).alias("s"))
    side = lambda s, k, v: x.select(*[F.col(c).alias(k if c == v else c) for c in ("axis", "judge", "entity_id")], F.col("s").alias(s))
    pairs = side("x", "judge_a", "judge").join(side("y", "judge_b", "judge"), ["axis", "entity_id"]).filter("judge_a < judge_b")
    rho = spearman(pairs, ["axis", "judge_a", "judge_b"], "x", "y")
    agreed = rho.groupBy("axis").agg(F.count("rho").alias("judge_pairs"), F.avg("rho").alias("transmissibility"))
    signal = x.groupBy("axis", "judge").agg(F.stddev_pop("s").alias("sd")).groupBy("axis").agg(F.avg("sd").alias("signal"))
    first = x.agg(F.min("judge").alias("judge"))
    a, b = (side(s, k, "axis").join(F.broadcast(first), "judge") for s, k in (("x", "axis_a"), ("y", "axis_b")))
    between = spearman(a.join(b, ["judge", "entity_id"]).filter("axis_a <> axis_b"), ["axis_a", "axis_b"], "x", "y")
    out = signal.join(agreed, "axis", "left").fillna(0, ["judge_pairs"])
    # as many rows as there are axes
    order = Window.orderBy(F.desc_nulls_last("transmissibility"), "axis")
    placed = out.withColumn("_n", F.row_number().over(order))
    at = lambda k: placed.select(F.col("axis").alias(k), F.col("_n").alias(f"_{k}"))
    closest = between.join(at("axis_a"), "axis_a").join(at("axis_b"), "axis_b").filter("_axis_b < _axis_a")
    closest = closest.groupBy(F.col("axis_a").alias("axis")).agg(F.max(F.abs("rho")).alias("redundancy"))
    return out.join(closest, "axis", "left").select(F.col("axis").alias(axis), "judge_pairs", "transmissibility", "signal", "redundancy")


def softmax2(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """``weight``: 2^score over the group's sum."""
    return rows.withColumn("weight", F.pow(F.lit(2.0), score) / F.sum(F.pow(F.lit(2.0), score)).over(Window.partitionBy(*keys)))


def nonnegative_weights(x: np.ndarray, y: np.ndarray, steps: int = 2000) -> np.ndarray:
    """Least squares with weights of at least 0, by projected gradient steps."""
    gram, target = x.T @ x, x.T @ y
    pace = 1 / max(np.linalg.eigvalsh(gram)[-1], 1e-12)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        new = np.maximum(w - pace * (gram @ w - target), 0.0)
        if np.abs(new - w).max() < 1e-12:
            return new
        w = new
    return w


def network_limit(matrix: np.ndarray, powers: int = 64, window: int = 16) -> np.ndarray:
    """Cesaro limit of a column-stochastic matrix: the mean of its last powers, which a cycle doesn't disturb."""
    m = matrix / np.maximum(matrix.sum(0, keepdims=True), 1e-300)
    base = np.linalg.matrix_power(m, powers)
    total = np.zeros_like(m)
    for _ in range(window):
        total += base
        base = base @ m
    return total / window


def probit_scores(n: int, i: np.ndarray, j: np.ndarray, cell: np.ndarray, cuts: np.ndarray, sigma: float = 1.0, ridge: float = 1e-6, rounds: int = 50) -> np.ndarray:
    """Mean-zero scores from censored readings: i over j fell into ``cell`` between neighbouring ``cuts``."""
    from math import erfc

    phi = lambda z: np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = lambda z: np.array([0.5 * erfc(-x / math.sqrt(2)) for x in z])
    edges = np.concatenate(([-40.0], cuts, [40.0]))

    def value(s: np.ndarray) -> float:
        d = s[i] - s[j]
        p = cdf((edges[cell + 1] - d) / sigma) - cdf((edges[cell] - d) / sigma)
        return float(np.log(np.maximum(p, 1e-300)).sum() - ridge * (s * s).sum() / 2)

    s = np.zeros(n)
    now = value(s)
    for _ in range(rounds):
        d = s[i] - s[j]
        lo, hi = (edges[cell] - d) / sigma, (edges[cell + 1] - d) / sigma
        p = np.maximum(cdf(hi) - cdf(lo), 1e-300)
        a, b = phi(lo), phi(hi)
        g = (a - b) / (p * sigma)
        h = np.maximum(g * g - (lo * a - hi * b) / (p * sigma * sigma), 1e-9)
        grad = np.bincount(i, g, n) - np.bincount(j, g, n) - ridge * s
        hess = np.zeros((n, n))
        np.add.at(hess, (i, i), h)
        np.add.at(hess, (j, j), h)
        np.add.at(hess, (i, j), -h)
        np.add.at(hess, (j, i), -h)
        step = np.linalg.solve(hess + max(ridge, 1e-9) * np.eye(n) + np.ones((n, n)) / n, grad)
        size = 1.0
        while size > 1e-6 and value(s + size * step) < now:
            size /= 2
        s = s + size * step
        s -= s.mean()
        new = value(s)
        if abs(new - now) < 1e-10:
            break
        now = new
    return s
