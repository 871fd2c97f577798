"""The most similar vectors of every query by randomly rotated one-bit codes.

Vectors are routed to the nearest centroid of their index's last complete checkpoint, queries to the
``probes`` nearest ones and on until enough vectors were seen; cells are counted, not believed.  Within a block of a cell every vector is one code
of at least ``BITS`` bits: the signs of its rotated unit residual, with two scalars (the residual's norm, and how far the code's direction
is from the residual's).  A query is rotated once and quantised to four bits, so inner products come
from AND and popcount on packed words.  The estimate has an error bound, which gives each vector a lower
and an upper distance; only vectors whose lower distance does not exceed the k-th smallest upper distance are
compared exactly.  A block's k best go to one global ranking by (squared distance, id).  Queries left with fewer than k visit
every cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.functions.vecmath import usable
from vecloom.operators.coarse import Cells, centroid_rows, counted, distinct, int64_lists, lists, matrix, over_cells, usable_vectors
from vecloom.sources.tables import durable, small_enough

#: Bits of a code at least; longer vectors have the next multiple of 64.  Shorter ones are padded with zeros before rotation.
BITS = 128
#: Width of the error bound in standard deviations of the estimate.
EPSILON = 3.0
#: Vectors a block is meant to hold; a cell counted to be larger is cut into several blocks by a hash of the id.
BLOCK = 8_192
#: Queries a block is meant to answer; a cell of more vectors has copies of its blocks, each for a part of the queries.
ASKING = 262_144
#: Cells a query visits at least; it goes on to further cells until those before hold ``SEEN`` vectors.
PROBES = 8
SEEN = 4_096
_PAIRS = 4_000_000

CODED = "index_id int, cluster int, salt int, side int, id bigint, vec array<float>"


def bits_of(d: int) -> int:
    return max(BITS, -(-d // 64) * 64)


@lru_cache(maxsize=4)
def rotation(d: int, seed: int = 20_240_527) -> np.ndarray:
    """The first ``d`` rows of a random orthonormal matrix of the code's length; the same on every worker."""
    bits = bits_of(d)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:d]


def encode(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed codes n x words, residual norms, alignment of code and residual) of the rows of ``x``."""
    residual = x - centre
    norms = np.sqrt((residual * residual).sum(1))
    turned = (residual / np.where(norms > 0, norms, 1.0)[:, None]) @ rotation(x.shape[1])
    codes = np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64)
    return codes, norms, np.abs(turned).sum(1) / np.sqrt(turned.shape[1])


def bounds(codes: np.ndarray, norms: np.ndarray, align: np.ndarray, queries: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper squared distances (queries x vectors) from the codes alone."""
    residual, bits = queries - centre, bits_of(queries.shape[1])
    q_norm = np.sqrt((residual * residual).sum(1))
    turned = (residual / np.where(q_norm > 0, q_norm, 1.0)[:, None]) @ rotation(queries.shape[1])
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / 15.0, 1e-12)
    levels = np.clip(np.rint((turned - low[:, None]) / step[:, None]), 0, 15).astype(np.uint8)
    planes = [np.packbits((levels >> j) & 1, axis=1, bitorder="little").view(np.uint64) for j in range(4)]
    ones = np.bitwise_count(codes).sum(1)
    weighted = np.zeros((len(queries), len(codes)), np.float32)
    for w in range(codes.shape[1]):
        for j, plane in enumerate(planes):
            weighted += np.bitwise_count(codes[:, w][None] & plane[:, w][:, None]) * np.float32(1 << j)
    on_ones = step[:, None] * weighted + low[:, None] * ones
    inner = (2.0 * on_ones - (step * levels.sum(1) + low * bits)[:, None]) / np.sqrt(bits)
    safe = np.where(align > 0, align, 1.0)
    cosine = inner / safe
    slack = EPSILON * (np.sqrt(np.maximum(0.0, 1.0 - safe * safe)) / np.sqrt(bits - 1) + step[:, None] / np.sqrt(12.0)) / safe
    base = norms * norms + (q_norm * q_norm)[:, None]
    scale = 2.0 * norms * q_norm[:, None]
    return base - scale * np.minimum(cosine + slack, 1.0), base - scale * np.maximum(cosine - slack, -1.0)


def search_block(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(qid, id, squared distance) of each query's k best distinct ids in the block, and the pairs compared exactly."""
    centre = x.mean(0)
    codes, norms, align = encode(x, centre)
    found, compared = [], 0
    for a in range(0, len(q), max(1, _PAIRS // len(x))):
        part = q[a : a + max(1, _PAIRS // len(x))]
        if len(x) > 2 * k:
            lower, upper = bounds(codes, norms, align, part, centre)
            kth = np.partition(upper, k - 1, axis=1)[:, k - 1]
            qi, xi = np.nonzero(lower <= kth[:, None] + 1e-6)
        else:
            qi, xi = (m.ravel() for m in np.meshgrid(np.arange(len(part)), np.arange(len(x)), indexing="ij"))
        compared += len(qi)
        diff = x[xi] - part[qi]
        dist = np.einsum("ij,ij->i", diff, diff)
        order = np.lexsort((ids[xi], dist, qi))
        qi, gid, dist = qi[order], ids[xi][order], dist[order]
        start = np.searchsorted(qi, qi)
        keep = np.arange(len(qi)) - start < k
        found.append((qids[a + qi[keep]], gid[keep], dist[keep]))
    return *(np.concatenate(c) for c in zip(*found)), compared


def _search(d: int, k: int):
    schema = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("sq_dist", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, ready = None, [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            index, cluster, salt, side, who = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            x = matrix(b.column(5), d)
            cuts = np.flatnonzero(np.r_[True, (index[1:] != index[:-1]) | (cluster[1:] != cluster[:-1]) | (salt[1:] != salt[:-1])])
            out = []
            for a, z in zip(cuts.tolist(), np.r_[cuts[1:], len(index)].tolist()):
                if (here := (int(index[a]), int(cluster[a]), int(salt[a]))) != key:
                    key, ids, vectors, ready = here, [], [], None
                split = a + int((side[a:z] == 0).sum())
                if split > a:
                    ids.append(who[a:split])
                    vectors.append(x[a:split])
                if split < z and ids:
                    if ready is None:
                        every, points = np.concatenate(ids), np.concatenate(vectors)
                        own = distinct(every, points)  # an id with several usable vectors keeps each; the nearest counts later
                        ready = every[own], points[own].astype(np.float64)
                    out.append(search_block(*ready, who[split:z], x[split:z].astype(np.float64), k)[:3])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return run


def _blocks(cells: Cells) -> np.ndarray:
    """Blocks of each cell, from the counted sizes."""
    return np.maximum(1, -(-cells.sizes // BLOCK))


def _parts(cells: Cells) -> np.ndarray:
    """Copies of each block: where many vectors are, many queries go."""
    return np.maximum(1, -(-cells.sizes // ASKING))


def _mixed(ids: np.ndarray, shift: int) -> np.ndarray:
    return (ids * np.int64(-7046029254386353131)) >> np.int64(shift)


def _place(cells: Cells, index: int, ids: np.ndarray, x: np.ndarray) -> list:
    home = cells.distances(x.astype(np.float64)).argmin(1)
    parts = _parts(cells)[home]
    who = np.repeat(np.arange(len(ids)), parts)
    part = np.arange(len(who)) - np.repeat(np.cumsum(parts) - parts, parts)
    salt = (_mixed(ids, 33) % _blocks(cells)[home])[who] * parts[who] + part
    n = len(who)
    return [np.full(n, index, np.int32), cells.clusters[home[who]], salt.astype(np.int32), np.zeros(n, np.int32), ids[who], lists(x[who])]


def _route(probes: int | None):
    """Queries to the cells they visit; to every cell without ``probes``."""

    def visit(cells: Cells, index: int, ids: np.ndarray, x: np.ndarray) -> list:
        near = np.argsort(cells.distances(x.astype(np.float64)), axis=1, kind="stable")
        held = cells.sizes[near]
        visited = (np.cumsum(held, axis=1) - held < SEEN) | (np.arange(near.shape[1]) < (probes or near.shape[1]))
        who, rank = np.nonzero(visited)
        cell = near[who, rank]
        blocks = _blocks(cells)[cell]
        who, cell = np.repeat(who, blocks), np.repeat(cell, blocks)
        salt = np.arange(len(who)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        parts = _parts(cells)[cell]
        salt = salt * parts + _mixed(ids[who], 29) % parts
        n = len(who)
        return [np.full(n, index, np.int32), cells.clusters[cell], salt.astype(np.int32), np.ones(n, np.int32), ids[who], lists(x[who])]

    return visit


def most_similar(vectors: DataFrame, queries: DataFrame, checkpoints: DataFrame, clusters: DataFrame, k: int = 10, d: int = 32, probes: int = PROBES) -> DataFrame:
    """(qid, global_id, sq_dist, rank): the k most similar usable vectors of each query's index.

    ``queries`` has (index_id, id, vec) with usable vectors.  Ranked by (squared distance, id); an id counts
    once.  Fewer than k rows come out only if the index has fewer ids; an index without vectors
    gives none.  Null, short, long and NaN vectors are never found; all-zero vectors are ordinary.  For
    answers that must be exact use ``operators.exact``.
    """
    stored = usable_vectors(vectors, d)
    cells = counted(stored, centroid_rows(checkpoints, clusters, d), d)

    def ranked(rows: DataFrame, asking: DataFrame, cells_each: int | None) -> DataFrame:
        placed = over_cells(rows, cells, d, _place, CODED)
        routed = over_cells(asking, cells, d, _route(cells_each), CODED)
        met = placed.unionByName(routed).repartition("index_id", "cluster", "salt").sortWithinPartitions("index_id", "cluster", "salt", "side")
        best = met.mapInArrow(_search(d, k), "qid bigint, id bigint, sq_dist double")
        # an id stands in one cell, unless it has several usable vectors
        once = best.groupBy("qid", "id").agg(F.min("sq_dist").alias("sq_dist"))
        order = F.row_number().over(W.partitionBy("qid").orderBy("sq_dist", "id"))
        return once.withColumn("rank", order).where(F.col("rank") <= k).select("qid", F.col("id").alias("global_id"), "sq_dist", "rank")

    found = durable(ranked(stored, queries, probes))
    full = found.where(F.col("rank") == k).select(F.col("qid").alias("id"))
    short = durable(queries.join(full, "id", "left_anti").select("index_id", "id", "vec"))
    concerned = short.select("index_id").distinct()
    if not short.limit(1).count():
        return found
    if small_enough(concerned, 16, 2**20):
        concerned = F.broadcast(concerned)
    again = ranked(stored.join(concerned, "index_id", "left_semi"), short, None)
    return found.join(full.withColumnRenamed("id", "qid"), "qid", "left_semi").unionByName(again)


def asked(queries: DataFrame, d: int = 32) -> DataFrame:
    """(index_id, id, vec) of the queries that ask something."""
    sound = F.col("qid").isNotNull() & F.col("index_id").isNotNull() & usable("q", d)
    return queries.where(sound).select("index_id", F.col("qid").alias("id"), F.col("q").cast("array<float>").alias("vec"))


def codes_table(vectors: DataFrame, checkpoints: DataFrame, clusters: DataFrame, d: int = 32) -> DataFrame:
    """(index_id, global_id, cluster, code, norm, align): every usable vector's code, in words of 64 bits, relative to its cell's centroid."""

    def visit(cells: Cells, index: int, ids: np.ndarray, x: np.ndarray) -> list:
        x = x.astype(np.float64)
        home = cells.distances(x).argmin(1)
        codes, norms, align = np.zeros((len(x), bits_of(d) // 64), np.uint64), np.zeros(len(x)), np.zeros(len(x))
        for c in np.unique(home):
            at = home == c
            codes[at], norms[at], align[at] = encode(x[at], cells.centroids[c])
        return [np.full(len(ids), index, np.int32), ids, cells.clusters[home], int64_lists(codes.view(np.int64)), norms, align]

    schema = "index_id int, global_id bigint, cluster int, code array<bigint>, norm double, align double"
    return over_cells(usable_vectors(vectors, d), centroid_rows(checkpoints, clusters, d), d, visit, schema).distinct()
