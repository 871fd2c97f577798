"""Searching cones: growing windows with a stopping test, in blocks of whole clusters.

Members lie by (index, cluster, part), each once, with their vector and projections; queries come to the parts they visit.  A part sorts its
cones along every axis, takes windows by binary search, compares by matrix products, and hands on per query at most k
rows per window level and the border gaps.  What a query stops at, and its k best, follow from those rows alone: candidate pairs
never leave a part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.functions.vecmath import sq_l2_at
from vecloom.operators.coarse import distinct, double_lists, in_order, matrix
from vecloom.sources.tables import ship_code

#: Pairs of a query and a member looked at together.
_PAIRS = 2_000_000
_NONE = 127
_SIDES = "index_id int, cluster int, part int, side int, id bigint, fans array<int>, proj array<double>, vec array<float>"


def window_levels(k: int, window: int) -> list[int]:
    """Windows tried: from max(k, 8), doubling, the last one being ``window``."""
    out = [max(k, 8)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def with_distance(pairs: DataFrame, asks: DataFrame, rows: DataFrame, d: int = 32) -> DataFrame:
    """(qid, id, sq): squared distance of given pairs; ``asks`` (qid, q), ``rows`` (id, vec)."""
    return pairs.join(asks, "qid").join(rows, "id").select("qid", "id", sq_l2_at("q", "vec", d).alias("sq"))


def best(scored: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, dist) by (distance, id)."""
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("sq", "id"))).where(F.col("rank") <= k)
    return ranked.select("qid", F.col("rank").cast("int").alias("rank"), "id", F.sqrt("sq").alias("dist"))


class Block:
    """One part of a cluster: distinct members, and their order along every axis of each cone."""

    def __init__(self, ids: np.ndarray, fans: np.ndarray, proj: np.ndarray, x: np.ndarray):
        own = distinct(ids, x)
        self.ids, self.proj, self.x, fans = ids[own], proj[own], x[own].astype(np.float64), fans[own]
        self.cones = {}
        for f in np.unique(fans).tolist():
            own = np.flatnonzero((fans == f).any(1))
            turn = np.stack([own[np.lexsort((self.ids[own], self.proj[own, a]))] for a in range(proj.shape[1])])
            self.cones[f] = (turn, np.stack([self.proj[turn[a], a] for a in range(len(turn))]))

    def levels(self, fans: np.ndarray, q_proj: np.ndarray, windows: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(level of every member for every query, border gap of every query at every level).

        A member's level is the first window that holds it in a visited cone, on either side of the query along some axis; a cone of
        at most twice the window is held whole.  The gap of a cone is the greatest over its axes of the smaller gap to the next
        member beyond the window; an axis that ends within the window has an endless one.  A query's gap is the least of its cones'.
        """
        level = np.full((len(fans), len(self.ids)), _NONE, np.int8)
        gaps = np.full((len(fans), len(windows)), np.inf)
        visited = []
        for f, (turn, value) in self.cones.items():
            if len(who := np.flatnonzero((fans == f).any(1))):
                visited.append((who, turn, value, [np.searchsorted(value[a], q_proj[who, a]) for a in range(len(turn))]))
        for j in range(len(windows) - 1, -1, -1):
            w = windows[j]
            for who, turn, value, at in visited:
                n = turn.shape[1]
                if n <= 2 * w:
                    level[np.ix_(who, turn[0])] = j
                    continue
                widest = np.full(len(who), -np.inf)
                for a in range(len(turn)):
                    place = at[a][:, None] + np.arange(-w, w)
                    inside = (place >= 0) & (place < n)
                    rows = np.repeat(np.arange(len(who)), inside.sum(1))
                    level[who[rows], turn[a][place[inside]]] = j
                    here = q_proj[who, a]
                    right, left = at[a] + w, at[a] - w - 1
                    over = np.where(right < n, np.abs(value[a][np.minimum(right, n - 1)] - here), np.inf)
                    under = np.where(left >= 0, np.abs(value[a][np.maximum(left, 0)] - here), np.inf)
                    widest = np.maximum(widest, np.minimum(over, under))
                gaps[who, j] = np.minimum(gaps[who, j], widest)
        return level, gaps

    def visited(self, fans: np.ndarray) -> np.ndarray:
        """Which queries find a member in one of their cones."""
        return np.isin(fans, list(self.cones)).any(1)


def _by_distance(block: Block, q: np.ndarray, level: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) that can be among the k nearest of the member's level, with a margin for rounding."""
    x = block.x
    dist = (x * x).sum(1)[None] + (q * q).sum(1)[:, None] - 2.0 * (q @ x.T)
    keep = np.zeros(dist.shape, bool)
    for j in np.unique(level).tolist():
        if j == _NONE:
            continue
        if len(x) <= k:
            keep |= level == j
            continue
        held = np.where(level <= j, dist, np.inf)
        kth = np.partition(held, k - 1, axis=1)[:, k - 1]
        keep |= (level == j) & (dist <= (kth + 1e-9 * (1.0 + np.abs(kth)))[:, None])
    return np.nonzero(keep)


def _by_sketch(block: Block, q: np.ndarray, level: np.ndarray, k: int, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one level through a lower bound: projections on orthonormal axes are never farther apart than the vectors.

    The max(3k, 50) candidates nearest by sketch give the k-th distance; only candidates whose bound is within it remain.
    """
    sx, sq = block.x @ axes.T, q @ axes.T
    low = np.where(level == _NONE, np.inf, (sx * sx).sum(1)[None] + (sq * sq).sum(1)[:, None] - 2.0 * (sq @ sx.T))
    first = max(3 * k, 50)
    limit = np.partition(low, first - 1, axis=1)[:, first - 1] if low.shape[1] > first else np.full(len(q), np.inf)
    qi, xi = np.nonzero((low <= limit[:, None]) & np.isfinite(low))
    exact = in_order(block.x[xi], q[qi])
    order = np.lexsort((exact, qi))
    qi, exact = qi[order], exact[order]
    kth = np.full(len(q), np.inf)
    at = np.arange(len(qi)) - np.searchsorted(qi, qi) == k - 1
    kth[qi[at]] = exact[at]
    return np.nonzero((low <= (kth + 1e-9 * (1.0 + np.where(np.isfinite(kth), kth, 0.0)))[:, None]) & np.isfinite(low))


def over_blocks(members: DataFrame, visits: DataFrame, answer, schema: str, d: int = 32) -> DataFrame:
    """Run ``answer(block, qids, fans, q_proj, q) -> list of columns`` wherever queries visit a part.

    ``members`` and ``visits`` as in ``cones``.  One shuffle of both by (index, cluster, part).
    """
    ship_code(members.sparkSession)
    rows = members.select("index_id", "cluster", "part", F.lit(0).alias("side"), "id", "fans", "proj", "vec")
    asks = visits.select("index_id", "cluster", "part", F.lit(1).alias("side"), F.col("qid").alias("id"), "fans", F.col("q_proj").alias("proj"), F.col("q").alias("vec"))
    met = rows.unionByName(asks).repartition("index_id", "cluster", "part").sortWithinPartitions("index_id", "cluster", "part", "side")

    def wide(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            index, cluster, part, side, who = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            cuts = np.flatnonzero(np.r_[True, (index[1:] != index[:-1]) | (cluster[1:] != cluster[:-1]) | (part[1:] != part[:-1])])
            for a, z in zip(cuts.tolist(), np.r_[cuts[1:], len(index)].tolist()):
                if (here := (int(index[a]), int(cluster[a]), int(part[a]))) != key:
                    key, held, block = here, [], None
                split = a + int((side[a:z] == 0).sum())
                if split > a:
                    s = b.slice(a, split - a)
                    held.append((who[a:split], wide(s.column(5)), wide(s.column(6)), matrix(s.column(7), d)))
                if split < z and held:
                    block = block or Block(*(np.concatenate(c) for c in zip(*held)))
                    s = b.slice(split, z - split)
                    fans, proj, q = wide(s.column(5)), wide(s.column(6)), matrix(s.column(7), d).astype(np.float64)
                    step = max(1, _PAIRS // len(block.ids))
                    for c in range(0, z - split, step):
                        at = slice(c, c + step)
                        yield from answer(block, who[split:z][at], fans[at], proj[at], q[at])

    return met.mapInArrow(run, schema)


def _records(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_FOUND = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("sq", pa.float64()), ("level", pa.int32()), ("gaps", pa.list_(pa.float64()))])


def _settle(windows: list[int], k: int):
    """Per query, rows sorted by (qid, sq, id), gap rows first: the window it stops at and its k best rows there."""
    schema = pa.schema([("qid", pa.int64()), ("rank", pa.int32()), ("id", pa.int64()), ("sq", pa.float64()), ("w", pa.int32()), ("certified", pa.bool_())])

    def done(t: pa.Table) -> pa.RecordBatch:
        qid = t.column(0).to_numpy()
        border = t.column(1).is_null().to_numpy()
        starts = np.flatnonzero(np.r_[True, qid[1:] != qid[:-1]])
        who = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(qid)]))
        gaps = np.full((len(qid), len(windows)), np.inf)
        gaps[border] = t.column(4).filter(pa.array(border)).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(windows))
        gap = np.minimum.reduceat(gaps, starts)
        ids, sq, level = (t.column(i).fill_null(0).to_numpy() for i in (1, 2, 3))
        # an id with several vectors counts once, at its nearest
        order = np.lexsort((np.arange(len(ids)), ids, border, who))
        again = np.zeros(len(ids), bool)
        again[order[1:]] = (ids[order[1:]] == ids[order[:-1]]) & (who[order[1:]] == who[order[:-1]]) & (border[order[1:]] == border[order[:-1]])
        row = ~border & ~again
        stop = np.full(len(starts), -1)
        sure = np.zeros(len(starts), bool)
        rank = np.zeros(len(ids), np.int64)
        for j, w in enumerate(windows):
            ok = row & (level <= w)
            count = np.cumsum(ok)
            count -= (count - ok)[starts][who]
            kth = np.full(len(starts), np.nan)
            last = ok & (count == k)
            kth[who[last]] = np.sqrt(sq[last])
            covered = np.isinf(gap[:, j]) | (gap[:, j] >= kth)
            now = (stop < 0) & (np.isnan(kth) | covered | (j == len(windows) - 1))
            stop[now], sure[now] = w, (covered & ~np.isnan(kth))[now]
            take = ok & now[who] & (count <= k)
            rank[take] = count[take]
        out = rank > 0
        return _records(schema, qid[out], rank[out].astype(np.int32), ids[out], sq[out], stop[who[out]].astype(np.int32), sure[who[out]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            qid = t.column(0).to_numpy()
            first = int(np.searchsorted(qid, qid[-1]))  # sorted: the last query may go on in the next batch
            if first:
                yield done(t.slice(0, first))
            rest = t.slice(first)
        if rest is not None:
            yield done(rest)

    return run


def adaptive(members: DataFrame, visits: DataFrame, k: int = 10, window: int = 50, d: int = 32, whole: bool = False, sketch: np.ndarray | None = None, fixed: bool = False) -> DataFrame:
    """(qid, rank, id, sq, w, certified): the k nearest members within the window each query stops at, by (squared distance, id).

    A query stops at the first window at which it has fewer than k candidates, or every visited cone is covered (on some axis both border
    gaps reach the k-th distance), or no window is left.  ``certified`` says that the cones were covered then; it speaks of visited cones
    only.  ``fixed`` takes ``window`` alone, ``whole`` every member of the visited clusters.  With ``sketch`` (orthonormal axes, one
    window only) distances are spared by the lower bound; the result is the same.  A query that finds no member in a
    visited cone gives no row; repeated rows count once.
    """
    windows = [window] if fixed or whole or sketch is not None else window_levels(k, window)

    def answer(block: Block, qids: np.ndarray, fans: np.ndarray, q_proj: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not whole:
            met = block.visited(fans)
            qids, fans, q_proj, q = qids[met], fans[met], q_proj[met], q[met]
        if not len(qids):
            return
        if whole:
            level, gaps = np.zeros((len(qids), len(block.ids)), np.int8), np.full((len(qids), 1), np.inf)
        else:
            level, gaps = block.levels(fans, q_proj, windows)
        qi, xi = _by_distance(block, q, level, k) if sketch is None else _by_sketch(block, q, level, k, sketch)
        n, m = len(qi), len(qids)
        gap = pa.ListArray.from_arrays(pa.array(np.r_[np.zeros(n, np.int32), np.arange(m + 1, dtype=np.int32) * gaps.shape[1]]), pa.array(gaps.ravel()))
        lack = np.r_[np.zeros(n, bool), np.ones(m, bool)]
        yield _records(
            _FOUND, np.r_[qids[qi], qids], pa.array(np.r_[block.ids[xi], np.zeros(m, np.int64)], mask=lack), pa.array(np.r_[in_order(block.x[xi], q[qi]), np.zeros(m)], mask=lack),
            pa.array(np.r_[np.array(windows, np.int32)[level[qi, xi]], np.zeros(m, np.int32)], mask=lack), gap,
        )

    rows = over_blocks(members, visits, answer, "qid bigint, id bigint, sq double, level int, gaps array<double>", d)
    settled = rows.repartition("qid").sortWithinPartitions("qid", F.asc_nulls_first("sq"), "id")
    return settled.mapInArrow(_settle(windows, k), "qid bigint, rank int, id bigint, sq double, w int, certified boolean")


def candidates(members: DataFrame, visits: DataFrame, w: int, d: int = 32, whole: bool = False) -> DataFrame:
    """(qid, id): members within ``w`` ranks on some axis of a visited cone; a cone of at most 2w members gives all.

    ``whole``: every member of the visited clusters, which is what visiting all their cones amounts to.
    """
    schema = pa.schema([("qid", pa.int64()), ("id", pa.int64())])

    def answer(block: Block, qids: np.ndarray, fans: np.ndarray, q_proj: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        level = np.zeros((len(qids), len(block.ids)), np.int8) if whole else block.levels(fans, q_proj, [w])[0]
        qi, xi = np.nonzero(level != _NONE)
        fresh = np.r_[True, (qi[1:] != qi[:-1]) | (block.ids[xi[1:]] != block.ids[xi[:-1]])] if len(qi) else np.zeros(0, bool)
        yield _records(schema, qids[qi[fresh]], block.ids[xi[fresh]])

    return over_blocks(members, visits, answer, "qid bigint, id bigint", d)


def candidate_counts(members: DataFrame, visits: DataFrame, w: int, d: int = 32) -> DataFrame:
    """(qid, n): how many candidates each query has; only numbers leave a part."""
    schema = pa.schema([("qid", pa.int64()), ("n", pa.int64())])

    def answer(block: Block, qids: np.ndarray, fans: np.ndarray, q_proj: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield _records(schema, qids, (block.levels(fans, q_proj, [w])[0] != _NONE).sum(1))

    return over_blocks(members, visits, answer, "qid bigint, n bigint", d).groupBy("qid").agg(F.sum("n").alias("n")).where("n > 0")


def nearest_others(members: DataFrame, visits: DataFrame, w: int = 8, d: int = 32) -> DataFrame:
    """(qid, id, sq, v): the two nearest members of each part within ``w`` ranks in a visited cone, and the way from them to the query."""
    schema = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("sq", pa.float64()), ("v", pa.list_(pa.float64()))])

    def answer(block: Block, qids: np.ndarray, fans: np.ndarray, q_proj: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        qi, xi = _by_distance(block, q, block.levels(fans, q_proj, [w])[0], 2)
        yield _records(schema, qids[qi], block.ids[xi], in_order(block.x[xi], q[qi]), double_lists(q[qi] - block.x[xi]))

    return over_blocks(members, visits, answer, "qid bigint, id bigint, sq double, v array<double>", d)


def filled(found: DataFrame, asks: DataFrame, live: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, fill): results of queries short of k rows are completed with the smallest live ids of the index not yet among them.

    ``found`` (qid, rank, id), ``asks`` (qid, index_id), ``live`` (index_id, id).
    """
    heads = live.withColumn("r", F.row_number().over(W.partitionBy("index_id").orderBy("id"))).where(F.col("r") <= 2 * k).drop("r")
    counts = found.groupBy("qid").agg(F.count("*").alias("have"))
    lacking = asks.join(counts, "qid", "left").withColumn("have", F.coalesce("have", F.lit(0))).where(F.col("have") < k)
    extra = lacking.join(heads, "index_id").join(found.select("qid", "id"), ["qid", "id"], "left_anti")
    extra = extra.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy("id"))).where(F.col("have") + F.col("r") <= k)
    kept = found.select("qid", "rank", "id", F.lit(False).alias("fill"))
    return kept.unionByName(extra.select("qid", (F.col("have") + F.col("r")).cast("int").alias("rank"), "id", F.lit(True).alias("fill")))
