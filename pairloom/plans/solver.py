"""Robust weighted least squares on the graph of fused edges, one group at a time.

The scale axis is the number of groups (run x axis x judge); a group gets its
edges, already fused, and gives rows of three kinds: ``node`` (score, variance,
component), ``edge`` (residual, final weight, leverage, leave-one-out z) and
``run`` (diagnostics).  Only the kinds that are asked for are worked out.  A task
reads its groups as Arrow batches, many at a time, so a small group costs little
more than its arithmetic.

A group of up to ``DENSE`` entities is solved with a dense factor.  A larger one
keeps its edges as lists: scores by conjugate gradients, variances and leverages
from ``PROBES`` random probes (their run says ``estimated``), some of them at a time,
bridges by a walk of the graph.  A group must fit the memory of one task: about 400
bytes an edge.
The split of its cycles is made for up to ``CYCLES_UP_TO`` entities and null beyond.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.session import default_parallelism

#: Entities up to which a group is solved with a dense factor, and up to which its cycles are split.
DENSE, CYCLES_UP_TO = 1500, 5000
#: Random probes behind estimated variances and leverages: a relative error of about sqrt(2 / PROBES).
PROBES = 128
#: Numbers that the probes hold at once and rows that a batch of the answer has: neither grows with a group.
PROBE_CELLS, BATCH_ROWS = 2_000_000, 50_000
#: Entities up to which a singular system is solved through its eigenvalues.
EXACT = 256


@dataclass(frozen=True)
class SolverConfig:
    huber_k: float = 1.5
    irls_max_iters: int = 12
    irls_tol: float = 1e-8
    ridge: float = 1e-9
    tiny: float = 1e-18
    rank_band_window: int = 5
    small_gap_threshold: float = 0.5
    max_rank_pairs: int = 200_000


@dataclass
class Solution:
    scores: np.ndarray
    variances: np.ndarray
    component: np.ndarray
    residual: np.ndarray
    lam_eff: np.ndarray
    leverage: np.ndarray
    loo_z: np.ndarray
    inverse: np.ndarray | None
    free: np.ndarray
    degraded: bool
    estimated: bool = False
    summary: dict = field(default_factory=dict)


def components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Label of each node: the least node of its component."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def median(x: np.ndarray) -> float:
    """The mean of the two middle values, by a sort: faster than NumPy's own for the small groups."""
    if not len(x):
        return 0.0
    x, mid = np.sort(x), len(x) // 2
    return float(x[mid] if len(x) % 2 else (x[mid - 1] + x[mid]) / 2)


def mad(x: np.ndarray) -> float:
    return 1.4826 * median(np.abs(x - median(x)))


def _factor(matrix: np.ndarray, ridge: float) -> tuple[np.ndarray | None, bool]:
    """Inverse of the reduced Laplacian, the ridge raised tenfold up to four times; whether it had to be."""
    eye = np.eye(len(matrix))
    for attempt in range(5):
        try:
            low = np.linalg.cholesky(matrix + ridge * 10**attempt * eye)
        except np.linalg.LinAlgError:
            continue
        half = np.linalg.inv(low)
        return half.T @ half, attempt > 0
    if len(matrix) <= EXACT:
        value, vector = np.linalg.eigh(matrix)
        good = value > 1e-12 * max(value.max(), 1e-300)
        return (vector[:, good] / value[good]) @ vector[:, good].T, True
    return None, True


class _Sparse:
    """The reduced Laplacian of a large group as lists of neighbours."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray, pinned: np.ndarray, ridge: float):
        src, dst = np.concatenate([i, j]), np.concatenate([j, i])
        self.order = np.argsort(src, kind="stable")
        self.dst, sources = dst[self.order], src[self.order]
        self.rows = np.flatnonzero(np.bincount(sources, minlength=n))
        self.starts = np.searchsorted(sources, self.rows)
        self.n, self.pinned, self.ridge = n, pinned, ridge

    def weigh(self, w: np.ndarray) -> None:
        self.w = np.concatenate([w, w])[self.order]
        self.degree = np.zeros(self.n)
        self.degree[self.rows] = np.add.reduceat(self.w, self.starts)
        self.degree[self.degree <= 0] = 1.0

    def apply(self, x: np.ndarray) -> np.ndarray:
        out = (self.degree + self.ridge)[:, None] * x
        out[self.rows] -= np.add.reduceat(self.w[:, None] * x[self.dst], self.starts, axis=0)
        out[self.pinned] = 0
        return out

    def solve(self, rhs: np.ndarray, tolerance: float = 1e-11) -> tuple[np.ndarray, bool]:
        """Conjugate gradients, all columns at once, scaled by the degrees; and whether they came to rest."""
        b = rhs.copy()
        b[self.pinned] = 0
        x, r = np.zeros_like(b), b
        z = r / self.degree[:, None]
        d, rz = z.copy(), (r * z).sum(0)
        size = np.maximum(rz, 1e-300)
        for _ in range(4 * self.n + 100):
            if (rz <= tolerance**2 * size).all():
                return x, True
            q = self.apply(d)
            step = np.where(rz > 1e-300, rz / np.maximum((d * q).sum(0), 1e-300), 0.0)
            x += step * d
            r = r - step * q
            z = r / self.degree[:, None]
            before, rz = rz, (r * z).sum(0)
            d = z + np.where(before > 1e-300, rz / np.maximum(before, 1e-300), 0.0) * d
        return x, False


def _probes(n: int, i: np.ndarray, j: np.ndarray, root: np.ndarray) -> Iterator[np.ndarray]:
    """What ``PROBES`` random signs of the edges, times their weights' ``root``, load the nodes with: some columns at a time, by the size of the group."""
    draw = np.random.default_rng(n)
    # a bit for each sign: 16 bytes an edge
    bits = [np.packbits(draw.choice([-1.0, 1.0], (min(10_000, len(i) - low), PROBES)) > 0, axis=1) for low in range(0, len(i), 10_000)]
    bits = np.concatenate([np.zeros((0, PROBES // 8), np.uint8), *bits])
    wide = max(1, min(PROBES, PROBE_CELLS // max(n, 2 * len(i))))
    for low in range(0, PROBES, wide):
        load = np.zeros((n, min(wide, PROBES - low)))
        for k in range(load.shape[1]):
            byte, bit = divmod(low + k, 8)
            signed = np.where(bits[:, byte] >> (7 - bit) & 1, root, -root)
            load[:, k] = np.bincount(i, signed, n) - np.bincount(j, signed, n)
        yield load


def bridges(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each edge whether its loss would cut its component, by one depth-first walk."""
    src = np.concatenate([i, j])
    order = np.argsort(src, kind="stable")
    to, edge = np.concatenate([j, i])[order].tolist(), (order % len(i)).tolist() if len(i) else []
    start = np.searchsorted(src[order], np.arange(n + 1)).tolist()
    seen, low, found = [-1] * n, [0] * n, np.zeros(len(i), dtype=bool)
    clock = 0
    for root in range(n):
        if seen[root] >= 0:
            continue
        seen[root] = low[root] = clock
        clock += 1
        stack = [(root, -1, start[root])]
        while stack:
            node, came, at = stack[-1]
            if at < start[node + 1]:
                stack[-1] = (node, came, at + 1)
                other, by = to[at], edge[at]
                if by == came:
                    continue
                if seen[other] >= 0:
                    low[node] = min(low[node], seen[other])
                else:
                    seen[other] = low[other] = clock
                    clock += 1
                    stack.append((other, by, start[other]))
            else:
                stack.pop()
                if stack:
                    up = stack[-1][0]
                    low[up] = min(low[up], low[node])
                    if low[node] > seen[up]:
                        found[came] = True
    return found


def solve_graph(n: int, i: np.ndarray, j: np.ndarray, mu: np.ndarray, lam: np.ndarray, config: SolverConfig = SolverConfig(), edges: bool = True, diagnostics: bool = True, dense: int | None = None) -> Solution:
    """Scores s with mu ~ s_i - s_j, reported as score minus the component's least.

    ``edges``: leverages and leave-one-out z too; ``diagnostics``: the summary too.
    """
    label = components(n, i, j)
    small = n <= (DENSE if dense is None else dense)
    free = np.flatnonzero(label != np.arange(n))
    size = len(free)
    # pinned nodes share one row behind the free ones, which is cut off
    at = np.full(n, size)
    at[free] = np.arange(size)
    a, b = at[i], at[j]
    cells = np.concatenate([a * (size + 1) + a, b * (size + 1) + b, a * (size + 1) + b, b * (size + 1) + a]) if small else None
    diagonal = np.arange(size)
    sparse = None if small else _Sparse(n, i, j, label == np.arange(n), config.ridge)

    def system(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lap = np.bincount(cells, np.concatenate([w, w, -w, -w]), (size + 1) ** 2).reshape(size + 1, size + 1)[:size, :size]
        flow = w * mu
        return lap, np.bincount(np.concatenate([a, b]), np.concatenate([flow, -flow]), size + 1)[:size]

    def solve(w: np.ndarray) -> tuple[np.ndarray, bool]:
        s = np.zeros(n)
        if not small:
            sparse.weigh(w)
            flow = w * mu
            got, rests = sparse.solve((np.bincount(i, flow, n) - np.bincount(j, flow, n))[:, None])
            return got[:, 0], not rests
        lap, rhs = system(w)
        lap[diagonal, diagonal] += config.ridge
        try:
            got = np.linalg.solve(lap, rhs)
            if np.isfinite(got).all():
                s[free] = got
                return s, False
        except np.linalg.LinAlgError:
            pass
        inverse, bad = _factor(system(w)[0], config.ridge)
        if inverse is not None and size:
            s[free] = inverse @ rhs
        return s, bad

    w, previous, degraded = lam.astype(float).copy(), math.inf, False
    for _ in range(config.irls_max_iters if len(lam) else 0):
        s, bad = solve(w)
        degraded |= bad
        r = mu - (s[i] - s[j])
        far = np.abs(r)
        scale = mad(r)
        if scale <= config.tiny or scale <= 1e-8 * far.max():
            scale = far.max()
        if scale <= config.tiny:
            break
        delta = config.huber_k * scale
        w = lam * np.where(far > delta, delta / (far + config.tiny), 1.0)
        objective = float((w * r * r).sum())
        if abs(previous - objective) <= config.irls_tol * max(previous if math.isfinite(previous) else 0, 1.0):
            break
        previous = objective
    variances = np.full(n, np.nan)
    full = None
    if small:
        lap, rhs = system(w) if size else (np.zeros((0, 0)), np.zeros(0))
        inverse, bad = _factor(lap, config.ridge)
        s = np.zeros(n)
        if inverse is None:
            inverse = np.diag(1 / np.maximum(np.diag(lap), config.tiny))
        elif size:
            s[free] = inverse @ rhs
        variances[free] = np.diag(inverse)
        full = np.zeros((n, n))
        full[np.ix_(free, free)] = inverse
        resistance = full[i, i] + full[j, j] - 2 * full[i, j]
    else:
        s, bad = solve(w)
        # the Laplacian is the product of its edges' roots: probes of the edges give differences, whose mean squares are resistances
        squares, resistance = np.zeros(n), np.zeros(len(i))
        for load in _probes(n, i, j, np.sqrt(w)):
            probed, rests = sparse.solve(load, 1e-8)
            bad |= not rests
            squares += (probed**2).sum(1)
            if edges or diagnostics:
                resistance += ((probed[i] - probed[j]) ** 2).sum(1)
        variances[free] = squares[free] / PROBES
        resistance /= PROBES
    degraded |= bad
    residual = mu - (s[i] - s[j])
    if len(lam):
        # a pinned node has the greatest variance of its component, a lone one the greatest of all
        most = np.full(n, -np.inf)
        np.maximum.at(most, label[free], variances[free])
        pinned = np.flatnonzero(label == np.arange(n))
        top = variances[free].max() if size else 1.0
        variances[pinned] = np.where(np.isfinite(most[pinned]), most[pinned], top)
    variances = np.where(np.isnan(variances), 1.0, variances)
    low = np.full(n, np.inf)
    np.minimum.at(low, label, s)
    scores = s - low[label]
    out = Solution(scores, variances, label, residual, w, np.zeros(len(i)), np.zeros(len(i)), full, free, degraded, not small)
    if edges or diagnostics:
        leverage = w * resistance
        base = residual * np.sqrt(lam)
        sigma = 1.4826 * np.sort(np.abs(base))[len(base) // 2] if len(base) else 0.0
        bridge = bridges(n, i, j)
        leverage = np.where(bridge, 1.0, np.minimum(leverage, 1.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            loo = np.where(bridge | (sigma <= config.tiny), np.nan, base / (sigma * np.sqrt(np.maximum(1 - leverage, 1e-300))))
        out.leverage, out.loo_z = leverage, loo
        if diagnostics:
            out.summary = _diagnostics(n, i, j, mu, out, bridge, config, sparse)
    return out


def triangles(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """(edge ij, edge jk, edge ik) of every triangle i < j < k, one in each row."""
    near = np.zeros((n, n), dtype=bool)
    near[i, j] = True
    order = np.argsort(i.astype(np.int64) * n + j)
    code = (i.astype(np.int64) * n + j)[order]
    edge = lambda a, b: order[np.searchsorted(code, a * n + b)]
    found = [np.zeros((0, 3), dtype=np.int64)]
    for a in range(n):
        after = np.flatnonzero(near[a])
        b, c = (after[x] for x in np.nonzero(near[np.ix_(after, after)]))
        if len(b):
            found.append(np.stack([edge(a, b), edge(b, c), edge(a, c)], axis=1))
    return np.concatenate(found)


def _common_before(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each edge i < j the nodes k < i that meet both; their sum is the number of triangles."""
    up = np.zeros((n, n), dtype=np.float32)
    up[i, j] = 1
    return (up.T @ up)[i, j].astype(np.int64)


def curl_rank(n: int, i: np.ndarray, j: np.ndarray, most: int) -> int:
    """Rank of the triangles in the cycle space, whose dimension is ``most``, exactly (modulo a large prime).

    Edges come in the order of (later node, earlier node), nodes of many edges first.
    The first triangle that an edge closes is a pivot of its own; of its others one
    for each connected part of the edge's common neighbours is enough, since between
    neighbours a tetrahedron gives the rest by triangles of earlier edges.
    """
    prime = 2**31 - 1
    place = np.empty(n, dtype=np.int64)
    place[np.argsort(-np.bincount(np.concatenate([i, j]), minlength=n), kind="stable")] = np.arange(n)
    a, b = np.minimum(place[i], place[j]), np.maximum(place[i], place[j])
    common = _common_before(n, a, b)
    rank = int((common > 0).sum())
    if rank == most:
        return rank
    near = np.zeros((n, n), dtype=bool)
    near[a, b] = near[b, a] = True
    pivots: dict[int, dict[int, int]] = {}

    def triangle(k: int, a: int, b: int) -> dict[int, int]:
        # an edge's number, later node first, is its place in the order
        return {b * n + a: 1, b * n + k: prime - 1, a * n + k: 1}

    def pivot(edge: int) -> dict[int, int] | None:
        if edge not in pivots:
            b, a = divmod(edge, n)
            both = near[a, :a] & near[b, :a]
            if not both.any():
                return None
            pivots[edge] = triangle(int(both.argmax()), a, b)
        return pivots[edge]

    several = np.flatnonzero(common > 1)
    for e in several[np.argsort(common[several], kind="stable")]:
        x, y = int(a[e]), int(b[e])
        left = np.flatnonzero(near[x, :x] & near[y, :x])
        first = True
        while len(left):
            part, front = np.zeros(n, dtype=bool), left[:1]
            inside = np.zeros(n, dtype=bool)
            inside[left] = True
            while len(front):
                part[front] = True
                front = np.flatnonzero(near[front].any(axis=0) & inside & ~part)
            if not first:
                column = triangle(int(left[0]), x, y)
                while column:
                    top = max(column)
                    by = pivot(top)
                    if by is None:
                        unit = pow(column[top], -1, prime)
                        pivots[top] = {k: v * unit % prime for k, v in column.items()}
                        rank += 1
                        break
                    factor = column[top]
                    for k, v in by.items():
                        new = (column.get(k, 0) - factor * v) % prime
                        if new:
                            column[k] = new
                        else:
                            column.pop(k, None)
                if rank == most:
                    return rank
            first = False
            left = left[~part[left]]
    return rank


def _project(forward, adjoint, target: np.ndarray, tolerance: float = 1e-22, noise: float = 1e-28) -> np.ndarray:
    """Projection of ``target`` onto the range of ``forward``: conjugate gradients on the least squares.

    It ends where the gradient's square is ``tolerance`` of the first one's, or within rounding of nought.
    """
    r = target.copy()
    s = d = adjoint(r)
    gamma = start = float(s @ s)
    largest = 0.0
    for _ in range(20 * len(target) + 100):
        if gamma <= max(tolerance * start, noise * largest * float(target @ target)):
            return target - r
        q = forward(d)
        size = float(q @ q)
        largest = max(largest, size / float(d @ d))
        r -= gamma / size * q
        s = adjoint(r)
        before, gamma = gamma, float(s @ s)
        d = s + gamma / before * d
    raise ArithmeticError("the split into curl and harmonic part doesn't converge")


def hodge(n: int, i: np.ndarray, j: np.ndarray, mu: np.ndarray, residual: np.ndarray, lam: np.ndarray, tiny: float = 1e-18, listed: int = 2_000_000) -> dict:
    """The residual's energy as local (triangle) and harmonic cycles, over that of the measurements.

    More than ``listed`` triangles aren't written out: their sums over an edge's
    common neighbours come from a product with the adjacency matrix.
    """
    energy = float((lam * mu * mu).sum()) + tiny
    parts = len(np.unique(components(n, i, j)))
    cycle_dim = len(i) - n + parts
    total = float((lam * residual * residual).sum())
    if not cycle_dim:
        return {"curl": 0.0, "harmonic": 0.0, "triangles": 0, "cycle_dim": 0, "harmonic_dim": 0}
    count = int(_common_before(n, i, j).sum())
    if not count:
        return {"curl": 0.0, "harmonic": total / energy, "triangles": 0, "cycle_dim": cycle_dim, "harmonic_dim": cycle_dim}
    # in the inner product weighted by lam: residual flows lam * r lie in the cycle space
    root = np.sqrt(np.maximum(lam, tiny))
    target = residual * root
    rank = curl_rank(n, i, j, cycle_dim)
    if count <= listed:
        ab, bc, ac = triangles(n, i, j).T
        # triangles of equal length: the range stays, the conditioning gets better
        size = 1 / np.sqrt(1 / root[ab] ** 2 + 1 / root[bc] ** 2 + 1 / root[ac] ** 2)

        def forward(turn: np.ndarray) -> np.ndarray:
            t = turn * size
            return (np.bincount(ab, t, len(root)) + np.bincount(bc, t, len(root)) - np.bincount(ac, t, len(root))) / root

        def adjoint(x: np.ndarray) -> np.ndarray:
            y = x / root
            return (y[ab] + y[bc] - y[ac]) * size

    else:
        near = np.zeros((n, n))
        near[i, j] = near[j, i] = 1.0
        common = (near @ near)[i, j]
        flow = np.zeros((n, n))

        def forward(x: np.ndarray) -> np.ndarray:
            """The curls' Gram matrix over the edges, which has the same range."""
            y = x / root
            flow[i, j], flow[j, i] = y, -y
            got = near @ flow
            return (common * y - got[i, j] + got[j, i]) / root

        adjoint = forward
    along = _project(forward, adjoint, target)
    local = float((along**2).sum())
    return {"curl": local / energy, "harmonic": max(total - local, 0.0) / energy, "triangles": count, "cycle_dim": cycle_dim, "harmonic_dim": cycle_dim - rank}


def _fiedler(n: int, i: np.ndarray, j: np.ndarray, s: Solution, sparse: _Sparse | None) -> float | None:
    """Second least eigenvalue of the Laplacian: nought for several components."""
    if n < 2:
        return None
    if len(np.unique(s.component)) > 1:
        return 0.0
    if sparse is None:
        cells = np.concatenate([i * n + i, j * n + j, i * n + j, j * n + i])
        return float(np.linalg.eigvalsh(np.bincount(cells, np.concatenate([s.lam_eff, s.lam_eff, -s.lam_eff, -s.lam_eff]), n * n).reshape(n, n))[1])
    # inverse iteration: the pinned system's answer, brought back to mean nought
    v = np.random.default_rng(1).normal(size=n)
    value = None
    for _ in range(200):
        v -= v.mean()
        v /= np.linalg.norm(v)
        got = sparse.solve(v[:, None], 1e-10)[0][:, 0]
        got -= got.mean()
        new = 1 / float(v @ got)
        if value is not None and abs(new - value) <= 1e-9 * new:
            return new
        v, value = got, new
    return value


def _diagnostics(n, i, j, mu, s: Solution, bridge, config: SolverConfig, sparse: _Sparse | None) -> dict:
    w, r = s.lam_eff, s.residual
    energy = float((w * mu * mu).sum()) + config.tiny
    spread = float(np.var(mu)) if len(mu) else 0.0
    mse = float((w * r * r).sum() / w.sum()) if len(mu) else 0.0
    parts = len(np.unique(s.component))
    out = {
        "entities": n,
        "edges": len(i),
        "components": parts,
        "hcr": min(max(float((w * r * r).sum()) / energy, 0.0), 1.0),
        "pcr": 1 - mse / spread if spread > config.tiny else 0.0,
        "foster": float(n - parts) if s.estimated else float(s.leverage.sum()),
        "bridges": int(bridge.sum()),
        "flagged": int((np.abs(np.nan_to_num(s.loo_z)) > 3).sum()),
        "degraded": bool(s.degraded),
        "estimated": bool(s.estimated),
        "cycle_dim": len(i) - n + parts,
    }
    if n <= CYCLES_UP_TO:
        out |= hodge(n, i, j, mu, r, w, config.tiny)
    out["fiedler"] = _fiedler(n, i, j, s, sparse)
    return out


_RUN = {
    "entities": "int", "edges": "int", "components": "int", "hcr": "double", "pcr": "double", "foster": "double", "bridges": "int", "flagged": "int",
    "degraded": "boolean", "estimated": "boolean", "curl": "double", "harmonic": "double", "triangles": "int", "cycle_dim": "int", "harmonic_dim": "int", "fiedler": "double",
}
_NODE = {"score": "double", "variance": "double"}
_EDGE = {"residual": "double", "mu": "double", "lam": "double", "lam_eff": "double", "leverage": "double", "loo_z": "double"}
_ROW = {"kind": "string", "i": "string", "j": "string", "component": "string", **_NODE, **_EDGE, **_RUN, "status": "string"}
_ARROW = {"double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
KINDS = ("node", "edge", "run")


def _codes(column: pa.Array) -> np.ndarray:
    """Numbers that tell a column's values apart; nulls are equal."""
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _solve_groups(table: pa.Table, keys: list[str], starts: np.ndarray, config: SolverConfig, kinds: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The rows of whole groups, which begin at ``starts`` of ``table``, in batches of about ``BATCH_ROWS``."""
    both = pa.chunked_array([*table.column("i").chunks, *table.column("j").chunks], pa.string()).combine_chunks().dictionary_encode()
    rank = np.empty(len(both.dictionary), np.int64)
    order = pc.sort_indices(both.dictionary)
    rank[order.to_numpy()] = np.arange(len(order))
    names = both.dictionary.take(order)
    code = rank[both.indices.to_numpy()]
    del both, rank
    i_all, j_all = code[: len(table)], code[len(table) :]
    mu, lam = (table.column(c).to_numpy() for c in ("mu", "lam"))
    ends = [*starts[1:], len(table)]
    # (kind, where the group begins, rows, values) of what is to go out next
    pieces: list[tuple[str, int, int, dict]] = []
    rows = 0
    for low, high in zip(starts, ends):
        order = np.lexsort((j_all[low:high], i_all[low:high])) + low
        own, at = np.unique(np.concatenate([i_all[order], j_all[order]]), return_inverse=True)
        i, j = at[: len(order)], at[len(order) :]
        s = solve_graph(len(own), i, j, mu[order], lam[order], config, "edge" in kinds, "run" in kinds)
        found = []
        if "node" in kinds:
            found.append(("node", low, len(own), {"i": own, "component": own[s.component], "score": s.scores, "variance": s.variances}))
        if "edge" in kinds:
            found.append(("edge", low, len(i), {"i": own[i], "j": own[j], "component": own[s.component[i]], "residual": s.residual, "mu": mu[order], "lam": lam[order], "lam_eff": s.lam_eff, "leverage": s.leverage, "loo_z": s.loo_z}))
        if "run" in kinds:
            found.append(("run", low, 1, {"status": "solved", **s.summary}))
        for kind, first, size, values in found:
            for cut in range(0, size, BATCH_ROWS):
                part = slice(cut, cut + BATCH_ROWS)
                pieces.append((kind, first, min(BATCH_ROWS, size - cut), {c: v[part] if isinstance(v, np.ndarray) else v for c, v in values.items()}))
                rows += pieces[-1][2]
                if rows >= BATCH_ROWS:
                    yield _batch(table, keys, names, pieces)
                    pieces, rows = [], 0
    if pieces:
        yield _batch(table, keys, names, pieces)


def _batch(table: pa.Table, keys: list[str], names: pa.Array, pieces: list[tuple[str, int, int, dict]]) -> pa.RecordBatch:
    """Pieces of ``_solve_groups`` as rows."""
    arrays, fields = [], []
    where = np.concatenate([np.full(n, at) for _, at, n, _ in pieces])
    for k in keys:
        arrays.append(table.column(k).take(pa.array(where)).combine_chunks())
        fields.append((k, arrays[-1].type))
    for c, kind in _ROW.items():
        column = [(values.get(c), n) for _, _, n, values in pieces]
        if c == "kind":
            parts = [pa.repeat(pa.scalar(k), n) for k, _, n, _ in pieces]
        elif c in ("i", "j", "component"):
            parts = [pa.nulls(n, pa.string()) if v is None else names.take(pa.array(v)) for v, n in column]
        elif c == "loo_z":
            parts = [pa.nulls(n, pa.float64()) if v is None else pa.array(v, pa.float64(), from_pandas=True) for v, n in column]
        else:
            parts = [pa.nulls(n, _ARROW[kind]) if v is None else pa.array(v if isinstance(v, np.ndarray) else [v], _ARROW[kind]) for v, n in column]
        arrays.append(pa.concat_arrays(parts))
        fields.append((c, _ARROW[kind]))
    return pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))


def solve_edges(edges: DataFrame, keys: list[str], config: SolverConfig = SolverConfig(), kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The rows of ``kinds`` for every group of ``keys``; ``edges`` has i < j, mu, lam."""
    types = {k: edges.schema[k].dataType.simpleString() for k in keys}

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            # where a group begins; the batch's last group may go on in the next batch
            new = np.zeros(batch.num_rows, dtype=bool)
            for k in keys:
                code = _codes(batch.column(k))
                new[1:] |= code[1:] != code[:-1]
            first = tuple(batch.column(k)[0].as_py() for k in keys)
            new[0] = first != last
            last = tuple(batch.column(k)[-1].as_py() for k in keys)
            at = np.flatnonzero(new)
            if not len(at):
                held.append(batch)
                continue
            if at[0] > 0:
                held.append(batch.slice(0, at[0]))
            if held:
                yield from _solve_groups(pa.Table.from_batches(held), keys, np.array([0]), config, kinds)
            if len(at) > 1:
                whole = batch.slice(at[0], at[-1] - at[0])
                yield from _solve_groups(pa.Table.from_batches([whole]), keys, at[:-1] - at[0], config, kinds)
            held = [batch.slice(at[-1])]
        if held:
            yield from _solve_groups(pa.Table.from_batches(held), keys, np.array([0]), config, kinds)

    schema = ", ".join(f"`{k}` {t}" for k, t in {**types, **_ROW}.items())
    # a fixed number of tasks: by bytes, many small groups would be put into one
    spread = edges.select(*keys, edges["i"].cast("string").alias("i"), edges["j"].cast("string").alias("j"), edges["mu"].cast("double").alias("mu"), edges["lam"].cast("double").alias("lam"))
    spread = spread.repartition(default_parallelism(edges.sparkSession), *keys) if keys else spread.coalesce(1)
    return spread.sortWithinPartitions(*keys).mapInArrow(solve, schema) if keys else spread.mapInArrow(solve, schema)


def pair_variances(edges: DataFrame, pairs: DataFrame, keys: list[str], config: SolverConfig = SolverConfig(irls_max_iters=0)) -> DataFrame:
    """(keys, i, j, variance, same_component) of the asked ``pairs`` (keys, i, j): the variance of their difference.

    In one component it is the effective resistance between them; entities of two
    components add their own variances; an entity without an edge gives null.
    ``i`` = ``j`` is allowed and gives 0.  Only the asked pairs are worked out: in
    a large group one system is solved for each of them.
    """
    types = {k: edges.schema[k].dataType.simpleString() for k in keys}

    def solve(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame(columns=[*keys, "i", "j", "variance", "same_component"])
        out = asked[[*keys, "i", "j"]].copy()
        if not len(own):
            return out.assign(variance=np.nan, same_component=False)
        names = np.unique(own[["i", "j"]].to_numpy(dtype=object).astype(str))
        i, j = np.searchsorted(names, own["i"].to_numpy(str)), np.searchsorted(names, own["j"].to_numpy(str))
        s = solve_graph(len(names), i, j, own["mu"].to_numpy(float), own["lam"].to_numpy(float), config, False, False)
        x, y = (np.minimum(np.searchsorted(names, asked[c].to_numpy(str)), len(names) - 1) for c in ("i", "j"))
        known = (names[x] == asked["i"].to_numpy(str)) & (names[y] == asked["j"].to_numpy(str))
        same = s.component[x] == s.component[y]
        if s.inverse is not None:
            r = s.inverse[x, x] + s.inverse[y, y] - 2 * s.inverse[x, y]
        else:
            sparse = _Sparse(len(names), i, j, s.component == np.arange(len(names)), config.ridge)
            sparse.weigh(s.lam_eff)
            r = np.zeros(len(x))
            for low in range(0, len(x), 64):
                a, b = x[low : low + 64], y[low : low + 64]
                load = np.zeros((len(names), len(a)))
                np.add.at(load, (a, np.arange(len(a))), 1.0)
                np.add.at(load, (b, np.arange(len(a))), -1.0)
                got = sparse.solve(load)[0]
                r[low : low + 64] = got[a, np.arange(len(a))] - got[b, np.arange(len(a))]
        r = np.where(same, np.maximum(r, 0.0), s.variances[x] + s.variances[y])
        return out.assign(variance=np.where(known, r, np.nan), same_component=known & same)

    schema = ", ".join([*(f"`{k}` {t}" for k, t in types.items()), "i string, j string, variance double, same_component boolean"])
    return edges.select(*keys, "i", "j", "mu", "lam").groupBy(*keys).cogroup(pairs.select(*[F.col(k).alias(k) for k in keys], "i", "j").groupBy(*keys)).applyInPandas(solve, schema)


def nodes_of(solved: DataFrame, keys: list[str]) -> DataFrame:
    return solved.filter("kind = 'node'").select(*keys, F.col("i").alias("entity_id"), "score", "variance", "component")


def edges_of(solved: DataFrame, keys: list[str]) -> DataFrame:
    return solved.filter("kind = 'edge'").select(*keys, "i", "j", "mu", "lam", "residual", "lam_eff", "leverage", "loo_z", "component")


def runs_of(solved: DataFrame, keys: list[str]) -> DataFrame:
    return solved.filter("kind = 'run'").select(*keys, "status", *_RUN)


def dersimonian_laird(pairs: pd.DataFrame, config: SolverConfig = SolverConfig()) -> dict | None:
    """Variance between pairs beside the variance within, from (i, j, k, mean, ss); None without a repeated pair."""
    pairs = pairs.sort_values(["i", "j"], ignore_index=True)
    repeated = pairs["k"] >= 2
    if not repeated.any():
        return None
    within = max(float(pairs.loc[repeated, "ss"].sum() / (pairs.loc[repeated, "k"] - 1).sum()), 1e-12)
    names = np.unique(pairs[["i", "j"]].to_numpy(dtype=object).astype(str))
    i, j = np.searchsorted(names, pairs["i"].to_numpy(str)), np.searchsorted(names, pairs["j"].to_numpy(str))
    w = pairs["k"].to_numpy(float) / within
    s = solve_graph(len(names), i, j, pairs["mean"].to_numpy(float), w, config, False, False)
    df = len(pairs) + len(np.unique(s.component)) - len(names)
    q = float((w * s.residual**2).sum())
    c = float(w.sum() - (w * w).sum() / w.sum())
    between = max(0.0, (q - df) / c) if c > 0 and df > 0 else 0.0
    return {"sigma_w2": within, "sigma_b2": between, "q": q, "df": df, "pairs": len(pairs)}


def pooled_scores(pairs: pd.DataFrame, config: SolverConfig = SolverConfig()) -> pd.DataFrame:
    """(entity_id, score, variance) with each pair weighed by the inverse of between + within / k; within alone where no pair is repeated."""
    pairs = pairs.sort_values(["i", "j"], ignore_index=True)
    found = dersimonian_laird(pairs, config) or {"sigma_w2": 1.0, "sigma_b2": 0.0}
    names = np.unique(pairs[["i", "j"]].to_numpy(dtype=object).astype(str))
    i, j = np.searchsorted(names, pairs["i"].to_numpy(str)), np.searchsorted(names, pairs["j"].to_numpy(str))
    w = 1 / np.maximum(found["sigma_b2"] + found["sigma_w2"] / pairs["k"].to_numpy(float), 1e-9)
    s = solve_graph(len(names), i, j, pairs["mean"].to_numpy(float), w, config, False, False)
    return pd.DataFrame({"entity_id": names, "score": s.scores, "variance": s.variances})


def fit_gains(rows: pd.DataFrame, reference: str, rounds: int = 50, tolerance: float = 1e-6) -> dict[str, float]:
    """Gain of each template against ``reference``, alternating with the scores; rows (i, j, m, template)."""
    names = np.unique(rows[["i", "j"]].to_numpy(dtype=object).astype(str))
    i, j = np.searchsorted(names, rows["i"].to_numpy(str)), np.searchsorted(names, rows["j"].to_numpy(str))
    m, kinds = rows["m"].to_numpy(float), rows["template"].to_numpy(str)
    gain = {t: 1.0 for t in np.unique(kinds)}
    plain = SolverConfig(huber_k=1e12, irls_max_iters=1)
    for _ in range(rounds):
        scaled = m / np.array([gain[t] for t in kinds])
        s = solve_graph(len(names), i, j, scaled, np.ones(len(m)), plain, False, False).scores
        d = s[i] - s[j]
        new = {}
        for t in gain:
            at = kinds == t
            square = float((d[at] ** 2).sum())
            new[t] = float((m[at] * d[at]).sum()) / square if square > 1e-18 else 1.0
        new = {t: g / new[reference] for t, g in new.items()} if reference in new else new
        change = max(abs(new[t] - gain[t]) for t in gain)
        gain = new
        if change < tolerance:
            break
    return gain
