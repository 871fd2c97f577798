"""Drift of a cluster's inserts: a running subspace of their displacements, and an alarm when it leaves the cluster's axes.

The displacement of an insert leads to it from its nearest neighbour within a small window of the cones it joins, or from the centroid if there
is none.  The state of a cluster is an orthonormal d x F basis, moved towards every displacement (Oja's rule) and orthonormalised
after each batch.  It starts from the first displacement, completed to a basis; from zero it could never move.  As the rule is linear in the
basis, a batch of displacements is one d x d matrix: those of a cluster are computed anywhere, and only applied in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions import vecmath as V
from vecloom.operators import coarse, cones, search
from vecloom.operators.coarse import matrix
from vecloom.operators.positions import running
from vecloom.sources.tables import durable, ship_code

#: Step of the rule, and the angle in degrees beyond which a cluster has drifted (fixed values of the index).
BETA, ANGLE = 0.01, 15.0
STATE = "index_id int, cluster int, n bigint, u array<double>, angle double, drifted boolean"


def start_basis(v: np.ndarray, fans: int) -> np.ndarray:
    """An orthonormal basis whose first column points along ``v``."""
    d = len(v)
    seed = np.eye(d)[:, : fans]
    full = np.column_stack([v, seed])
    q, _ = np.linalg.qr(full)
    q = q[:, : min(fans, d)]
    return q * np.where(q[:, 0] @ v < 0, -1.0, 1.0)


def step(u: np.ndarray, batch: np.ndarray, beta: float = BETA) -> np.ndarray:
    """The basis after the rows of ``batch``, in order."""
    for v in batch:
        u = (1.0 - beta) * u + (beta * v)[:, None] * (v @ u)[None]
    return orthonormal(u)


def orthonormal(u: np.ndarray) -> np.ndarray:
    q, r = np.linalg.qr(u)
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def angle(u: np.ndarray, axes: np.ndarray) -> float:
    """Degrees between the leading direction and the nearest axis."""
    lengths = np.maximum(np.linalg.norm(axes, axis=1), 1e-12)
    return float(np.degrees(np.arccos(np.clip(np.abs(axes @ u[:, 0] / lengths).max(), 0.0, 1.0))))


def _advance(state: np.ndarray | None, batch: np.ndarray, fans: int) -> np.ndarray | None:
    """Displacements of length 0 move nothing; each counts with its direction only."""
    units = _units(batch)
    if not len(units):
        return state
    return step(start_basis(units[0], fans) if state is None else state, units)


def displacements(batch: DataFrame, members: DataFrame, cells, axes, fans: int = 2, d: int = 32, w: int = 8) -> DataFrame:
    """(index_id, cluster, seq, v) of ``batch`` (index_id, id, vec, seq): from the nearest other member within ``w`` ranks of the ``fans``
    cones it joins in its nearest cluster, else from that cluster's centroid.

    ``members`` as in ``cones``.  Indexes without centroids have none.
    """
    asks = batch.select("index_id", F.col("seq").alias("id"), "vec")
    home = coarse.nearest_cells(asks, cells, d=d, carry=True).where("cluster >= 0")
    rows = cells.rows if isinstance(cells, coarse.Prepared) else cells
    mu = rows.toDF("index_id", "cluster", "mu", *rows.columns[3:])
    centred = home.join(mu.select("index_id", "cluster", "mu"), ["index_id", "cluster"]).select("index_id", "cluster", F.col("id").alias("seq"), V.centre("vec", "mu").alias("from_mu"))
    joins = cones.visits(asks, cells, axes, 1, fans, d).join(home.select(F.col("id").alias("qid"), "cluster"), ["qid", "cluster"], "left_semi")
    near = search.nearest_others(members, joins, w, d)
    others = near.join(batch.select(F.col("seq").alias("qid"), F.col("id").alias("own")), "qid").where("id <> own")
    best = others.groupBy(F.col("qid").alias("seq")).agg(F.min_by("v", F.struct("sq", "id")).alias("v"))
    return centred.join(best, "seq", "left").select("index_id", "cluster", "seq", F.coalesce("v", "from_mu").alias("v"))


_CHUNKS = "index_id int, cluster int, chunk bigint, n bigint, first array<double>, m array<double>"


def _units(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1)
    return x[norms > 1e-10] / norms[norms > 1e-10][:, None]


def drift_states(displaced: DataFrame, axes: list[tuple[int, list[float]]], limit: float = ANGLE, chunk: int = 4_096, before: DataFrame | None = None) -> DataFrame:
    """(index_id, cluster, n, u, angle, drifted) of every cluster after its displacements (index_id, cluster, seq, v).

    Applied in order of ``seq`` in chunks of ``chunk`` rows, each its own task's work, so a large cluster is spread; one row of d x d numbers per chunk
    is applied in order.  ``before`` are states to go on from.  A displacement of length 0 moves nothing; each counts with its direction only.
    """
    ship_code(displaced.sparkSession)
    a = np.array([v for _, v in axes])
    d, fans = a.shape[1], len(a)
    key = ["index_id", "cluster"]
    # kept first: the ranges of ``running`` are sampled from it before they are cut
    steps = durable(displaced.select(*key, "seq", "v", F.lit(1).alias("one")))
    placed = running(steps, key, "seq", [], "one", "place")
    lean = placed.select(*key, F.floor(F.col("place") / chunk).alias("chunk"), "place", "v")
    rows = lean.repartition(*key, "chunk").sortWithinPartitions(*key, "chunk", "place")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, first, m = None, 0, None, np.eye(d)

        def done() -> pa.RecordBatch:
            scale = np.abs(m).max()
            return pa.RecordBatch.from_pylist([dict(zip(("index_id", "cluster", "chunk", "n", "first", "m"), (*now, n, None if first is None else first.tolist(), (m / scale).ravel().tolist())))], schema=target)

        target = pa.schema([("index_id", pa.int32()), ("cluster", pa.int32()), ("chunk", pa.int64()), ("n", pa.int64()), ("first", pa.list_(pa.float64())), ("m", pa.list_(pa.float64()))])
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            x = matrix(b.column(4), d)
            cuts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in keys], axis=0)] if b.num_rows > 1 else [True])
            for s, z in zip(cuts.tolist(), np.r_[cuts[1:], b.num_rows].tolist()):
                if (here := tuple(int(c[s]) for c in keys)) != now:
                    if now is not None:
                        yield done()
                    now, n, first, m = here, 0, None, np.eye(d)
                n += z - s
                for v in _units(x[s:z]):
                    first = v if first is None else first
                    m = (1.0 - BETA) * m + (BETA * v)[:, None] * (v @ m)[None]
        if now is not None:
            yield done()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, u = None, 0, None
        names = ("index_id", "cluster", "n", "u", "angle", "drifted")
        target = pa.schema([("index_id", pa.int32()), ("cluster", pa.int32()), ("n", pa.int64()), ("u", pa.list_(pa.float64())), ("angle", pa.float64()), ("drifted", pa.bool_())])

        def done() -> pa.RecordBatch:
            at = angle(u, a) if u is not None else 0.0
            return pa.RecordBatch.from_pylist([dict(zip(names, (*now, n, [] if u is None else u.ravel().tolist(), at, at > limit)))], schema=target)

        for b in batches:
            for r in b.to_pylist():
                if (here := (r["index_id"], r["cluster"])) != now:
                    if now is not None:
                        yield done()
                    now, n, u = here, 0, None
                n += r["n"]
                if r["chunk"] < 0:
                    u = np.array(r["m"]).reshape(d, fans) if r["m"] else None
                elif r["first"] is not None:
                    u = orthonormal(np.array(r["m"]).reshape(d, d) @ (start_basis(np.array(r["first"]), fans) if u is None else u))
        if now is not None:
            yield done()

    chunks = rows.select(*key, "chunk", "place", "v").mapInArrow(products, _CHUNKS)
    if before is not None:
        chunks = chunks.unionByName(before.select(*key, F.lit(-1).cast("bigint").alias("chunk"), "n", F.lit(None).cast("array<double>").alias("first"), F.col("u").alias("m")))
    return chunks.repartition(*key).sortWithinPartitions(*key, "chunk").mapInArrow(apply, STATE)


def drift_stream(displaced: DataFrame, axes: list[tuple[int, list[float]]], limit: float = ANGLE) -> DataFrame:
    """The same over a stream: one row per cluster and micro-batch, the basis kept as keyed state."""
    ship_code(displaced.sparkSession)
    a = np.array([v for _, v in axes])

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, u = (state.get[0], np.array(state.get[1]).reshape(-1, len(a)) if len(state.get[1]) else None) if state.exists else (0, None)
        rows = pd.concat(list(frames)).sort_values("seq")
        u = _advance(u, np.array(rows["v"].tolist()), len(a))
        n += len(rows)
        flat = [] if u is None else u.ravel().tolist()
        state.update((n, flat))
        at = angle(u, a) if u is not None else 0.0
        yield pd.DataFrame({"index_id": [key[0]], "cluster": [key[1]], "n": [n], "u": [flat], "angle": [at], "drifted": [at > limit]})

    return displaced.groupBy("index_id", "cluster").applyInPandasWithState(update, STATE, "n bigint, u array<double>", "update", "NoTimeout")


def profile(centred: DataFrame, axes: list[tuple[int, list[float]]], d: int, least: int = 10) -> DataFrame:
    """(index_id, cluster, n, angle, explained): per cluster the angle of the principal direction to the nearest axis, and its share of variance.

    ``centred`` (index_id, cluster, v).  Second moments are summed per partition of a cluster and then merged, d x d numbers each, so a
    large cluster is spread over all tasks.  Clusters of fewer than ``least`` rows are left out.
    """
    ship_code(centred.sparkSession)
    a = np.array([v for _, v in axes])

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for frame in frames:
            for key, part in frame.groupby(["index_id", "cluster"], sort=False):
                x = np.array(part["v"].tolist(), float)
                at = held.setdefault(key, [0, np.zeros((d, d))])
                at[0] += len(x)
                at[1] += x.T @ x
        if held:
            yield pd.DataFrame([{"index_id": k[0], "cluster": k[1], "n": n, "m": m.ravel().tolist()} for k, (n, m) in held.items()])

    def lead(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        n, m = int(frame["n"].sum()), np.sum([np.array(v).reshape(d, d) for v in frame["m"]], axis=0)
        values, vectors = np.linalg.eigh(m)
        total = values.sum()
        return pd.DataFrame({"index_id": [key[0]], "cluster": [key[1]], "n": [n], "angle": [angle(vectors[:, -1:], a)], "explained": [float(values[-1] / total) if total > 0 else 0.0]})

    parts = centred.select("index_id", "cluster", "v").mapInPandas(moments, "index_id int, cluster int, n bigint, m array<double>")
    return parts.groupBy("index_id", "cluster").applyInPandas(lead, "index_id int, cluster int, n bigint, angle double, explained double").where(F.col("n") >= least)
