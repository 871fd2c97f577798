"""Choosing build parameters: scaling rules, a Gaussian process over alpha = nlist / sqrt(n), and a sweep of search settings.

Trial indexes are built in numpy on a bounded sample, one Spark task for each number of cones per vector; the winner is built on everything, and all
its search settings are counted in one pass over the blocks that the widest of them visits.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators import cones
from vecloom.operators.coarse import Cells, lloyd
from vecloom.operators.projection import random_axes
from vecloom.operators.search import Block, over_blocks
from vecloom.sources.tables import ship_code

#: Range of alpha, and the least members a cone should have (fixed values of the index).
ALPHA, LEAST_CONE = (0.25, 3.0), 5
#: Cones per vector that are tried, queries of the trials and of the sweep, and bounds of the sample (fixed values of the index).
CONES, ASKED, SWEPT, SAMPLE = (1, 2, 3), 10, 50, (5_000, 50_000)
#: Length scales tried, and the noise of the process (fixed values).
SCALES, NOISE, MARGIN = (0.05, 0.1, 0.25, 0.5, 1.0, 2.0), 1e-3 + 1e-6, 0.01


def scale_params(n: int, d: int) -> tuple[int, int, int]:
    """(fans, wide fans, base window) for n vectors of d elements."""
    raw = d / 8 * max(1.0, math.log2(n / 5000)) if n > 0 else 16
    fans = int(min(64, max(16, round(raw / 8) * 8)))
    return fans, min(128, 2 * fans), max(15, int(15 * math.sqrt(n / 10_000)))


def viable_fans(n: int, nlist: int, wide: int) -> int:
    """The most fans that leave a cone at least LEAST_CONE members on average, else 16."""
    good = [f for f in (16, 32, 64, wide) if n // max(1, nlist * f) >= LEAST_CONE]
    return max(good, default=16)


class Process:
    """A Gaussian process of one variable on 0..1 with a squared-exponential kernel.

    All length scales are weighed at once, each kernel by its eigenvalues.
    """

    def fit(self, x: list[float], y: list[float]) -> Process:
        self.x, y = np.array(x), np.array(y)
        self.shift, self.size = y.mean(), max(y.std(), 1e-9)
        z = (y - self.shift) / self.size
        values, vectors = np.linalg.eigh(np.stack([self._kernel(self.x, self.x, s) for s in SCALES]))
        values = values + NOISE
        turned = np.einsum("snk,n->sk", vectors, z)
        likelihood = -0.5 * (turned**2 / values + np.log(values)).sum(1)
        best = int(likelihood.argmax())
        self.scale, self.values, self.vectors = SCALES[best], values[best], vectors[best]
        self.weights = self.vectors @ (turned[best] / self.values)
        return self

    @staticmethod
    def _kernel(a: np.ndarray, b: np.ndarray, scale: float) -> np.ndarray:
        return np.exp(-0.5 * ((a[:, None] - b[None]) / scale) ** 2)

    def predict(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self._kernel(self.x, at, self.scale)
        explained = ((self.vectors.T @ k) ** 2 / self.values[:, None]).sum(0)
        return self.shift + self.size * (k.T @ self.weights), self.size * np.sqrt(np.maximum(1e-12, 1.0 - explained))

    def improvement(self, at: np.ndarray, best: float) -> np.ndarray:
        mean, spread = self.predict(at)
        gain = mean - best - MARGIN
        z = gain / spread
        return gain * norm_cdf(z) + spread * norm_pdf(z)


def norm_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.array([math.erf(v / math.sqrt(2)) for v in z]))


def norm_pdf(z: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def tune_alpha(score: Callable[[float], float], trials: int = 10, bounds: tuple[float, float] = ALPHA) -> tuple[float, float, list[tuple[float, float]]]:
    """(alpha, its score, all trials): maximise ``score`` by expected improvement over a grid; both ends and the middle come first."""
    low, high = bounds
    tried = [(a, score(a)) for a in (low, (low + high) / 2, high)]
    grid = np.linspace(0, 1, 300)
    for _ in range(max(0, trials - len(tried))):
        process = Process().fit([(a - low) / (high - low) for a, _ in tried], [s for _, s in tried])
        gain = process.improvement(grid, max(s for _, s in tried))
        known = np.array([(a - low) / (high - low) for a, _ in tried])
        gain[np.abs(grid[:, None] - known[None]).min(1) < 1 / 40] = -np.inf
        at = float(low + grid[int(gain.argmax())] * (high - low))
        tried.append((at, score(at)))
    alpha, best = max(tried, key=lambda t: t[1])
    return alpha, best, tried


def settings(fans: int, base_window: int) -> list[tuple[int, int, int]]:
    """(cluster probes, fan probes, window) of a sweep."""
    fan_probes = sorted({min(f, fans) for f in (2, 4, 8, max(1, fans // 4), max(1, fans // 2), fans)})
    windows = sorted({max(1, int(m * base_window)) for m in (0.25, 0.5, 1.0, 1.5, 2.0)})
    return [(cp, fp, w) for cp in (5, 10, 20) for fp in fan_probes for w in windows]


def sample_size(n: int, wanted: int | None = None) -> int:
    """Vectors a trial is built on: a tenth, at least 5,000, at most 50,000 or as many as ``wanted``."""
    return min(wanted or SAMPLE[1], max(SAMPLE[0], n // 10), n)


def operating_points(fans: int, window: int) -> list[tuple[int, int, int]]:
    """(cluster probes, fan probes, window) a trial is scored at: cheap, middle, thorough."""
    return [(3, max(1, fans // 4), max(1, window // 2)), (5, max(1, fans // 2), window), (10, fans, window)]


class Trial:
    """An index in memory, of the same blocks that searches on tables use."""

    def __init__(self, x: np.ndarray, nlist: int, fans: int, top: int, seed: int = 0):
        self.cells = Cells(np.arange(nlist, dtype=np.int32), lloyd(x, nlist, seed, False), *np.zeros((2, nlist), np.int64))
        home = self.cells.distances(x).argmin(1)
        self.axes = random_axes(fans, x.shape[1], seed, orthonormal=True)
        proj, best = self._placed(x - self.cells.centroids[home])
        ids = np.arange(len(x))
        self.blocks = {c: Block(ids[at], best[at, :top], proj[at], x[at]) for c in np.unique(home).tolist() if len(at := np.flatnonzero(home == c))}

    def _placed(self, centred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        proj = centred @ self.axes.T
        return proj, np.argsort(-np.abs(proj), axis=1, kind="stable")

    def candidates(self, q: np.ndarray, probes: int, fan_probes: int, window: int) -> set[int]:
        """Places of the vectors that one query looks at."""
        dist = self.cells.distances(q[None])[0]
        near = [c for c in np.argsort(dist, kind="stable").tolist() if c in self.blocks][:probes]
        out: set[int] = set()
        for c in near:
            proj, best = self._placed(q[None] - self.cells.centroids[c])
            block = self.blocks[c]
            out |= set((block.ids if fan_probes >= len(self.axes) else block.ids[block.levels(best[:, :fan_probes], proj, [window])[0][0] == 0]).tolist())
        return out


def score(x: np.ndarray, queries: np.ndarray, alpha: float, top: int, fans: int, window: int, k: int, seed: int = 0) -> float:
    """Mean recall of a trial over its operating points."""
    k = min(k, len(x))
    trial = Trial(x, int(max(1, min(len(x), round(alpha * math.sqrt(len(x)))))), fans, top, seed)
    near = [set(np.argsort(((x - q) ** 2).sum(1), kind="stable")[:k].tolist()) for q in queries]
    points = operating_points(fans, window)
    return float(np.mean([len(trial.candidates(q, *p) & want) / k for p in points for q, want in zip(queries, near)]))


def trials(spark: SparkSession, x: np.ndarray, queries: np.ndarray, fans: int, window: int, k: int, count: int, seed: int = 0) -> list[tuple[int, float, float]]:
    """(cones per vector, alpha, score) of every trial; a task for each number of cones."""
    held = spark.sparkContext.broadcast((x, queries))

    def run(batches):
        for b in batches:
            for top in b.column(0).to_pylist():
                tried = tune_alpha(lambda alpha: score(*held.value, alpha, top, fans, window, k, seed), count)[2]
                yield pa.RecordBatch.from_arrays([pa.array([top] * len(tried), pa.int32()), pa.array([t[0] for t in tried]), pa.array([t[1] for t in tried])], names=["top", "alpha", "score"])

    ship_code(spark)
    each = spark.createDataFrame([(t,) for t in CONES], "top int").repartition(len(CONES), "top")
    return sorted((r["top"], r["alpha"], r["score"]) for r in each.mapInArrow(run, "top int, alpha double, score double").collect())


def sweep(members: DataFrame, queries: DataFrame, cells, axes, truth: dict[int, set[int]], fans: int, base_window: int, d: int) -> DataFrame:
    """(cp, fp, w, cands, recall): every setting of :func:`settings`, from one pass over the blocks the widest visits.

    ``queries`` (index_id, id, vec) with ids 0, 1, 2, ...; ``truth``: their true nearest, at most SWEPT queries.
    """
    every = settings(fans, base_window)
    probes, counts, windows = (sorted(set(v)) for v in zip(*every))
    visited = cones.visits(queries, cells, axes, max(probes), fans, d)
    marked = visited.withColumn("qid", F.col("qid") * 64 + F.col("cluster_rank"))
    schema = pa.schema([("turn", pa.int64()), ("fp", pa.int32()), ("w", pa.int32()), ("cands", pa.int64()), ("hits", pa.int64())])

    def answer(block: Block, qids: np.ndarray, fans_: np.ndarray, q_proj: np.ndarray, q: np.ndarray):
        true = np.stack([np.isin(block.ids, list(truth.get(int(i) // 64, ()))) for i in qids])
        for fp in counts:
            level = np.zeros((len(qids), len(block.ids)), np.int8) if fp >= fans else block.levels(fans_[:, :fp], q_proj, windows)[0]
            for j, w in enumerate(windows):
                held = level <= j
                yield pa.RecordBatch.from_arrays([pa.array(qids, pa.int64()), pa.array([fp] * len(qids), pa.int32()), pa.array([w] * len(qids), pa.int32()), pa.array(held.sum(1)), pa.array((held & true).sum(1))], schema=schema)

    rows = over_blocks(members, marked, answer, "turn bigint, fp int, w int, cands bigint, hits bigint", d)
    steps = rows.withColumn("cp", F.explode(F.array(*map(F.lit, probes)))).where(F.col("turn") % 64 <= F.col("cp"))
    n, k = max(1, len(truth)), max(1, max(map(len, truth.values()), default=1))
    return steps.groupBy("cp", "fp", "w").agg((F.sum("cands") / F.lit(n)).alias("cands"), (F.sum("hits") / F.lit(n * k)).alias("recall"))
