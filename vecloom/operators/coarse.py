"""The coarse groups of the last complete checkpoints: centroids per index, and assignment of vectors to them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions.vecmath import usable
from vecloom.sources.tables import durable, last_checkpoints, ship_code, slices

#: Above this many bytes the centroids are no longer shipped to every worker but joined by index.
SHIP_LIMIT = 16 * 2**20


@dataclass
class Cells:
    """Centroids of one index, ordered by cluster number.

    ``counts`` are the sizes the checkpoint states, ``sizes`` the counted ones (see :func:`counted`; those stated, if nobody counted).
    Only ``sizes`` decide how work is split.
    """

    clusters: np.ndarray
    centroids: np.ndarray
    counts: np.ndarray
    sizes: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of the rows of ``x`` to every centroid."""
        c = self.centroids
        return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2.0 * (x @ c.T), 0.0)


def whole(d: int) -> Cells:
    """The single cell of an index without a complete checkpoint."""
    return Cells(np.array([-1], np.int32), np.zeros((1, d)), np.zeros(1, np.int64), np.zeros(1, np.int64))


def centroid_rows(checkpoints: DataFrame, clusters: DataFrame, d: int) -> DataFrame:
    """(index_id, cluster, centroid, stated): one row per cluster of each last complete checkpoint.

    Repeated rows of a cluster count once (the greatest centroid is kept); unusable centroids are left out, and negative zeros are zeros.
    """
    last = last_checkpoints(checkpoints).select("index_id", "checkpoint_id")
    positive = F.transform("centroids", lambda x: x + F.lit(0.0).cast("float")).alias("centroids")
    stated = F.coalesce("cluster_counts", F.lit(0)).alias("stated")
    rows = clusters.where(F.col("cluster").isNotNull() & usable("centroids", d)).select("checkpoint_id", "cluster", positive, stated)
    return rows.join(last, "checkpoint_id").groupBy("index_id", "cluster").agg(F.max("centroids").alias("centroid"), F.max("stated").alias("stated"))


def gather(rows: Iterator) -> dict[int, Cells]:
    """Centroid rows (index_id, cluster, centroid, stated and, if counted, the count) as cells by index."""
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1], r[2], r[3], r[4] if len(r) > 4 else r[3]))
    out = {}
    for index, members in by.items():
        members.sort(key=lambda m: m[0])
        cluster, centroid, stated, size = zip(*members)
        out[index] = Cells(np.array(cluster, np.int32), np.array(centroid, np.float64), np.array(stated, np.int64), np.array(size, np.int64))
    return out


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column whose rows all have ``d`` elements as an (n, d) array, without a copy."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), d)


@dataclass
class Prepared:
    """Centroid rows, and what the workers get of them: all cells by index, or None if they are too many."""

    rows: DataFrame
    shipped: object | None


def _most(d: int, ship_limit: int | None) -> int:
    """Cells that may be shipped."""
    return (SHIP_LIMIT if ship_limit is None else ship_limit) // (4 * d + 32)


def prepare(centroids: DataFrame, d: int, ship_limit: int | None = None) -> Prepared:
    """Ship the centroids to the workers if all of them fit ``ship_limit`` bytes (SHIP_LIMIT unless given).

    One job that reads no more rows than the limit allows, and one.
    """
    most = _most(d, ship_limit)
    rows = centroids.limit(most + 1).collect()
    return Prepared(centroids, centroids.sparkSession.sparkContext.broadcast(gather(rows)) if len(rows) <= most else None)


def counted(rows: DataFrame, centroids: DataFrame | Prepared, d: int, ship_limit: int | None = None) -> Prepared:
    """The cells with the number of ``rows`` (index_id, id, vec) nearest to each, whatever a checkpoint states.

    An index without centroids gets its cell -1.  One pass over the vectors, which leaves a row per cell and batch; cells too many to
    ship are kept in the shared folder.
    """

    def visit(cells: Cells, index: int, ids: np.ndarray, x: np.ndarray) -> list:
        cell, n = np.unique(cells.distances(x.astype(np.float64)).argmin(1), return_counts=True)
        return [np.full(len(cell), index, np.int32), cells.clusters[cell], n]

    known = centroids if isinstance(centroids, Prepared) else prepare(centroids, d, ship_limit)
    counts = over_cells(rows, known, d, visit, "index_id int, cluster int, n bigint").groupBy("index_id", "cluster").agg(F.sum("n").alias("n"))
    most = _most(d, ship_limit)
    if known.shipped is not None and len(got := counts.limit(most + 1).collect()) <= most:
        held = {(r["index_id"], r["cluster"]): r["n"] for r in got}
        cells = {i: replace(c, sizes=np.array([held.get((i, k), 0) for k in c.clusters.tolist()], np.int64)) for i, c in known.shipped.value.items()}
        for (i, k), n in held.items():
            if i not in cells and k == -1:
                cells[i] = replace(whole(d), sizes=np.array([n], np.int64))
        return Prepared(known.rows, rows.sparkSession.sparkContext.broadcast(cells))
    origin = F.array(*[F.lit(0.0).cast("float")] * d)
    cells = known.rows.toDF("index_id", "cluster", "centroid", "stated", *known.rows.columns[4:]).select("index_id", "cluster", "centroid", "stated")
    table = cells.join(counts, ["index_id", "cluster"], "full").select(
        "index_id", "cluster", F.coalesce(F.col("centroid").cast("array<float>"), origin).alias("centroid"),
        F.coalesce("stated", F.lit(0)).cast("bigint").alias("stated"), F.coalesce("n", F.lit(0)).alias("counted"),
    )
    return Prepared(durable(table), None)


#: Result columns a visit may give.
_TYPES = {
    "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()),
    "array<float>": pa.list_(pa.float32()), "array<double>": pa.list_(pa.float64()),
}


def over_cells(rows: DataFrame, centroids: DataFrame | Prepared, d: int, visit, schema: str, salts: int | None = None) -> DataFrame:
    """Run ``visit(cells, index_id, ids, vectors) -> list of columns`` over ``rows`` (index_id, id, vec), by index.

    ``vec`` must be usable.  If the centroids were shipped, ``rows`` stay where they are.  Else rows meet the
    centroids of their index in a shuffle by (index, salt): each index is cut into ``salts`` parts (four for each shuffle partition unless
    given), so a large index doesn't fill one task, and a part holds the centroids of one index next to its rows, which stream past.
    """
    ship_code(rows.sparkSession)
    known = centroids if isinstance(centroids, Prepared) else prepare(centroids, d)
    centroids, shipped, salts = known.rows, known.shipped, salts or 4 * slices(rows.sparkSession)
    target = pa.schema([(name, _TYPES[kind]) for name, kind in (c.strip().split(" ", 1) for c in schema.split(","))])

    def emit(cells: Cells | None, index: int, ids: np.ndarray, x: np.ndarray):
        columns = visit(cells or whole(d), index, ids, x)
        arrays = [c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, target)]
        return pa.RecordBatch.from_arrays(arrays, schema=target)

    if shipped is not None:

        def run(batches):
            for b in batches:
                index, ids, x = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), matrix(b.column(2), d)
                for i in np.unique(index).tolist():
                    at = index == i
                    yield emit(shipped.value.get(i), i, ids[at], x[at])

        return rows.select("index_id", "id", "vec").mapInArrow(run, schema)

    # whose turn it is: 0 a centroid (its two sizes beside it), 1 a row
    size = "counted" if "counted" in centroids.columns else "stated"
    salted_cells = centroids.select(
        "index_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("side"), F.col("cluster").cast("bigint").alias("id"),
        F.col("centroid").cast("array<float>").alias("vec"), F.col("stated").cast("bigint").alias("stated"), F.col(size).cast("bigint").alias("size"),
    )
    salt = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt")
    nothing = F.lit(0).cast("bigint")
    salted_rows = rows.select("index_id", salt, F.lit(1).alias("side"), "id", "vec", nothing.alias("stated"), nothing.alias("size"))
    met = salted_cells.unionByName(salted_rows).repartition("index_id", "salt").sortWithinPartitions("index_id", "salt", "side")

    def meet(batches):
        key, known = None, []
        for b in batches:
            index, salt, side, ids, stated, sizes = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3, 5, 6))
            x = matrix(b.column(4), d)
            cuts = np.flatnonzero(np.r_[True, (index[1:] != index[:-1]) | (salt[1:] != salt[:-1])])
            for a, z in zip(cuts, np.r_[cuts[1:], len(index)]):
                if (here := (int(index[a]), int(salt[a]))) != key:
                    key, known = here, []
                split = a + int((side[a:z] == 0).sum())
                known += [(key[0], int(ids[k]), x[k].tolist(), int(stated[k]), int(sizes[k])) for k in range(a, split)]
                if split < z:
                    yield emit(gather(known).get(key[0]), key[0], ids[split:z], x[split:z])

    return met.select("index_id", "salt", "side", "id", "vec", "stated", "size").mapInArrow(meet, schema)


def distinct(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which rows to keep, sorted by id: whole rows repeated once; an id with several vectors keeps each."""
    order = np.argsort(ids, kind="stable")
    if (ids[order][1:] == ids[order][:-1]).any():
        order = np.lexsort((*x.T[::-1], ids))
        return order[np.r_[True, (ids[order][1:] != ids[order][:-1]) | (x[order][1:] != x[order][:-1]).any(1)]]
    return order


def lists(x: np.ndarray) -> pa.Array:
    """Rows of a float matrix as a list column of 32-bit floats."""
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(x.astype(np.float32).ravel()))


def double_lists(x: np.ndarray) -> pa.Array:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(x.astype(np.float64).ravel()))


def int_lists(x: np.ndarray) -> pa.Array:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(x.astype(np.int32).ravel()))


def int64_lists(x: np.ndarray) -> pa.Array:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(x, np.int64).ravel()))


def usable_vectors(vectors: DataFrame, d: int) -> DataFrame:
    """(index_id, id, vec) of the rows with an index, an id and a usable vector."""
    sound = F.col("global_id").isNotNull() & F.col("index_id").isNotNull() & usable("vector", d)
    return vectors.where(sound).select("index_id", F.col("global_id").alias("id"), F.col("vector").cast("array<float>").alias("vec"))


def nearest_cells(rows: DataFrame, centroids: DataFrame | Prepared, top: int = 1, d: int = 32, filled_only: bool = False, carry: bool = False) -> DataFrame:
    """(index_id, id, cluster, sq_dist, rank[, vec]): the ``top`` nearest centroids of each row, ties by cluster number.

    An index without centroids has the one cell -1 at the origin.  ``filled_only`` passes over cells stated to be empty; ``carry`` keeps the
    vector with its row.
    """

    def visit(cells: Cells, index: int, ids: np.ndarray, x: np.ndarray) -> list:
        x = x.astype(np.float64)
        dist = cells.distances(x)
        if filled_only and (cells.counts > 0).any():
            dist = np.where(cells.counts > 0, dist, np.inf)
        near = np.argsort(dist, axis=1, kind="stable")[:, :top]
        who, cell = np.repeat(np.arange(len(ids)), near.shape[1]), near.ravel()
        there = np.isfinite(dist[who, cell])
        rank = np.tile(np.arange(1, near.shape[1] + 1, dtype=np.int32), len(ids))
        who, cell, rank = who[there], cell[there], rank[there]
        exact = in_order(x[who], cells.centroids[cell])
        out = [np.full(len(who), index, np.int32), ids[who], cells.clusters[cell], exact, rank]
        return [*out, lists(x[who])] if carry else out

    schema = "index_id int, id bigint, cluster int, sq_dist double, rank int"
    return over_cells(rows, centroids, d, visit, schema + (", vec array<float>" if carry else ""))


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of row pairs, summed from the first element to the last as SQL does."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        diff = a[:, j] - b[:, j]
        total += diff * diff
    return total


def in_order_dots(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Products of every row with every axis, summed from the first element to the last."""
    total = np.zeros((len(x), len(axes)))
    for j in range(x.shape[1]):
        total += x[:, j : j + 1] * axes[:, j][None]
    return total


#: Rounds and tolerance of k-means (fixed values of the index).
ROUNDS, STILL, TINY = 20, 1e-6, 1e-10


def lloyd(x: np.ndarray, k: int, seed: int, spherical: bool) -> np.ndarray:
    """k centroids of the rows of ``x``: random distinct rows first, empty ones seeded again, until nothing moves."""
    g = np.random.default_rng(seed)
    mu = x[g.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([((mu * mu).sum(1) - 2.0 * (x[a : a + 16_384] @ mu.T)).argmin(1) for a in range(0, len(x), 16_384)])
        counts = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        filled = np.flatnonzero(counts)
        new = x[g.choice(len(x), k)].copy()
        new[filled] = np.add.reduceat(x[order], np.r_[0, np.cumsum(counts[filled])[:-1]], axis=0) / counts[filled][:, None]
        if spherical:
            new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), TINY)
        moved, mu = np.abs(new - mu).max(), new
        if moved <= STILL:
            break
    return mu
