"""The projection index: rank windows on sorted projections, one list per direction."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.operators.coarse import distinct, double_lists, in_order, in_order_dots, matrix
from vecloom.operators.positions import running
from vecloom.sources.tables import durable, ship_code, slices, small_enough

#: Places of a sorted list that are searched together at least, and at most unless a window is wider.
LEAST_BLOCK, MOST_BLOCK = 1_024, 8_192
_PAIRS = 2_000_000
#: Points of a group up to which a task holds all of them, pairs of a point and a query that a task goes through, and queries that are worth another reading of the points.
WHOLE, WORK, LEAST_ASKS = 524_288, 64_000_000, 640
#: The same where points come as places in sorted lists: points of a part, and queries.
LIST_PART, LIST_ASKS = 32_768, 2_048
#: Bytes up to which the layout of the groups (a row each) is broadcast.
LAYOUT_LIMIT = 4 * 2**20


def random_axes(count: int, d: int, seed: int = 0, orthonormal: bool = False) -> np.ndarray:
    """Seeded directions: unit rows, or orthonormal ones; of the latter there are at most ``d``."""
    g = np.random.default_rng(seed).standard_normal((min(count, d) if orthonormal else count, d))
    return np.linalg.qr(g.T)[0].T[: len(g)] if orthonormal else g / np.linalg.norm(g, axis=1, keepdims=True)


def axis_table(spark, axes: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(v) for v in a]) for i, a in enumerate(axes)], "axis int, a array<double>")


def axis_rows(axes: DataFrame) -> list[tuple[int, list[float]]]:
    """The directions as values; their number is a parameter of an index (at most the dimension), not data."""
    return sorted((r["axis"], list(r["a"])) for r in axes.select("axis", "a").distinct().collect())


def projections(rows: DataFrame, axes: DataFrame, vec: str, d: int, name: str = "proj") -> DataFrame:
    """``rows`` with an array of the projections of ``vec`` (usable) on every axis, in the order of the axes.

    Sums run from the first element to the last, by Arrow batches.
    """
    ship_code(rows.sparkSession)
    a = np.array([v for _, v in axis_rows(axes)], np.float64)
    at, names = rows.columns.index(vec), [*rows.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dots = double_lists(in_order_dots(matrix(b.column(at), d).astype(np.float64), a))
            yield pa.RecordBatch.from_arrays([*b.columns, dots], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, `{name}` array<double>")


def by_axis(projected: DataFrame, *keep: str) -> DataFrame:
    return projected.select(*keep, F.posexplode("proj").alias("axis", "p"))


def sorted_lists(points: DataFrame, asks: DataFrame, by: list[str], carry: bool = False) -> DataFrame:
    """Points (id) and queries (qid) on each axis with ``pos``: how many points of the group have a smaller projection.

    For a point ties count smaller ids too, so ``pos`` is its place in the sorted list; for a query it is the insertion point before equals.
    ``carry`` keeps ``vec`` with each row, for :func:`nearest_in_windows`.
    """
    more = ["vec"] if carry else []
    p = by_axis(points, *by, "id", *more).select(*by, "axis", "p", F.lit(1).alias("is_point"), F.col("id").alias("who"), *more)
    q = by_axis(asks, *by, "qid", *more).select(*by, "axis", "p", F.lit(0).alias("is_point"), F.col("qid").alias("who"), *more)
    return running(p.unionByName(q), [*by, "axis"], "p", ["is_point", "who"], "is_point", "pos")


def _window(w: int | str) -> Column:
    return F.col(w) if isinstance(w, str) else F.lit(w)


def window_counts(lists: DataFrame, by: list[str], w: int | str) -> DataFrame:
    """(axis, n): members of all queries' windows, from the places alone."""
    n = lists.where("is_point = 1").groupBy(*by, "axis").agg(F.count("*").alias("size"))
    q = lists.where("is_point = 0").join(n, [*by, "axis"])
    members = F.least(F.col("pos") + _window(w), F.col("size")) - F.greatest(F.col("pos") - _window(w), F.lit(0))
    return q.groupBy("axis").agg(F.sum(members).alias("n"))


def window_members(lists: DataFrame, by: list[str], w: int | str) -> DataFrame:
    """(qid, id, axis): points at places [pos - w, pos + w) around each query's insertion point.

    ``w`` may name a column of ``by`` that holds the window of a group.  Joined on blocks of ``w`` places, of which a window meets at most three.
    """
    w = _window(w)
    q = lists.where("is_point = 0").select(*by, "axis", F.col("who").alias("qid"), F.col("pos").alias("at"))
    q = q.withColumn("block", F.explode(F.sequence(F.floor((F.greatest(F.col("at") - w, F.lit(0))) / w), F.floor((F.col("at") + w - 1) / w))))
    p = lists.where("is_point = 1").select(*by, "axis", F.col("who").alias("id"), "pos", F.floor(F.col("pos") / w).alias("block"))
    return q.join(p, [*by, "axis", "block"]).where((F.col("pos") >= F.col("at") - w) & (F.col("pos") < F.col("at") + w)).select("qid", "id", "axis")


def scaled(lists: DataFrame, by: list[str], share: float, least: int) -> DataFrame:
    """``lists`` with the window ``w`` of each group: ``share`` of its points, at least ``least``."""
    n = lists.where("axis = 0 and is_point = 1").groupBy(*by).agg(F.greatest(F.lit(least), F.ceil(F.count("*") * share)).cast("int").alias("w"))
    return lists.join(n, by)


def candidates(lists: DataFrame, by: list[str], w: int | str) -> DataFrame:
    """(qid, id): the union of the windows over all axes."""
    return window_members(lists, by, w).select("qid", "id").distinct()


def _lone(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """As :func:`distinct`; only vectors of repeated ids are sorted."""
    order = np.argsort(ids, kind="stable")
    same = ids[order][1:] == ids[order][:-1]
    more = np.r_[same, False] | np.r_[False, same]
    some = order[more]
    kept = np.r_[order[~more], some[distinct(ids[some], x[some])]] if len(some) else order
    return kept[np.argsort(ids[kept], kind="stable")]


class _Sorted:
    """All points of a group in the order of each axis, by (projection, id)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, axes: np.ndarray, share: float, least: int):
        own, self.axes = _lone(ids, x), axes
        ids, x = ids[own], x[own]
        fresh = np.r_[True, ids[1:] != ids[:-1]]
        self.ids, place = ids[fresh], np.cumsum(fresh) - 1
        self.n, self.w = len(ids), max(least, math.ceil(len(ids) * share))
        self.p, self.order = np.empty((len(axes), self.n)), np.empty((len(axes), self.n), np.intp)
        for a in range(0, self.n, MOST_BLOCK):
            self.p[:, a : a + MOST_BLOCK] = in_order_dots(x[a : a + MOST_BLOCK].astype(np.float64), axes).T
        for i, p in enumerate(self.p):
            order = np.argsort(p, kind="stable")
            self.order[i], self.p[i] = place[order], p[order]

    def windows(self, q: np.ndarray) -> Iterator[list[np.ndarray]]:
        """Per query the windows about it, as places in ``ids``."""
        at = np.stack([np.searchsorted(p, c) for p, c in zip(self.p, in_order_dots(q.astype(np.float64), self.axes).T)], 1)
        for los, his in zip(np.maximum(at - self.w, 0).tolist(), (at + self.w).tolist()):
            yield [order[lo:hi] for order, lo, hi in zip(self.order, los, his)]


class _Placed:
    """Some points of sorted lists (axis, pos), in the order of each axis."""

    def __init__(self, ids: np.ndarray, axis: np.ndarray, pos: np.ndarray, _):
        self.ids, place = np.unique(ids, return_inverse=True)
        self.lists = {}
        for a in np.unique(axis).tolist():
            own = np.flatnonzero(axis == a)
            own = own[np.argsort(pos[own], kind="stable")]
            self.lists[a] = pos[own], place[own]

    def windows(self, axis: np.ndarray, pos: np.ndarray, w: np.ndarray) -> Iterator[list[np.ndarray]]:
        """Per query and axis the points at places [pos - w, pos + w)."""
        for a, lo, hi in zip(axis.tolist(), (pos - w).tolist(), (pos + w).tolist()):
            at, place = self.lists.get(a, (np.empty(0), np.empty(0, np.intp)))
            yield [place[slice(*np.searchsorted(at, (lo, hi)).tolist())]]


def _unions(m: int, d: int, ready_of, name: str):
    """(qid, id), each pair of a key once, of rows (key of ``m`` columns, side, who, ...) sorted by key, side and who: points of a key come first, then its queries.

    ``ready_of`` makes the points of a key ready to be asked for windows.
    """
    schema = pa.schema([("qid", pa.int64()), (name, pa.int64())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        last, parts, ready, asking, mark = None, [], None, None, None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys = [b.column(i).to_numpy(zero_copy_only=False) for i in range(m)]
            side, who = (b.column(m + i).to_numpy(zero_copy_only=False) for i in range(2))
            rest = [matrix(c, d) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in b.columns[m + 2 :]]
            cuts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in keys], axis=0)] if n > 1 else [True])
            for a, z in zip(cuts.tolist(), np.r_[cuts[1:], n].tolist()):
                if (here := tuple(c[a] for c in keys)) != last:
                    if asking is not None:
                        yield asking, ready.ids[np.flatnonzero(mark)]
                    last, parts, ready, asking = here, [], None, None
                split = a + int((side[a:z] == 0).sum())
                if split > a:
                    parts.append([c[a:split].copy() for c in (who, *rest)])
                if split == z or not (parts or ready):
                    continue
                if not ready:
                    points = [np.concatenate(c) for c in zip(*parts)]
                    parts = []
                    ready = ready_of(*points)
                    mark = np.zeros(len(ready.ids), bool)
                for qid, windows in zip(who[split:z].tolist(), ready.windows(*(c[split:z] for c in rest))):
                    if qid != asking:  # a query's rows may lie in two batches
                        if asking is not None:
                            yield asking, ready.ids[np.flatnonzero(mark)]
                        asking = qid
                        mark[:] = False
                    for w in windows:
                        mark[w] = True
        if asking is not None:
            yield asking, ready.ids[np.flatnonzero(mark)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, ids, held = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(qids, np.int64), [len(i) for i in ids])), pa.array(np.concatenate(ids), pa.int64())], schema=schema)

        for qid, some in found(batches):
            qids.append(qid)
            ids.append(some)
            held += len(some)
            if held >= _PAIRS // 2:
                yield out()
                qids, ids, held = [], [], 0
        if qids:
            yield out()

    return run


def _met(points: DataFrame, asks: DataFrame, layout: DataFrame, by: list[str], d: int, ready_of, part: int, least_asks: int, work: int, name: str) -> DataFrame:
    """(qid, ``name``) of the windows that ``asks`` (by, qid, ...) have among ``points`` (by, id, ...); ``layout``: (by, n, asks), the groups to be searched.

    A group's points are cut by their id into parts of about ``part``, its queries by theirs into chunks; a chunk and a part meet in one
    task, which takes as many neighbouring ones as make about ``work`` pairs.  So a pair is found once, and none is shuffled.
    """
    pairs = F.col("n") * F.col("asks")
    total = layout.agg(F.sum(pairs)).first()[0] or 0
    work = max(1, min(work, total // (2 * slices(points.sparkSession))))
    before = F.coalesce(F.sum(pairs).over(W.orderBy(*by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = F.ceil(F.col("n") / part)
    chunks = F.ceil(F.col("asks") / F.greatest(F.lit(least_asks), F.floor(F.lit(work) * parts / F.col("n"))))
    layout = durable(layout.select(*by, before.alias("_before"), parts.cast("int").alias("_parts"), chunks.cast("int").alias("_chunks"), (pairs / (parts * chunks)).alias("_each")))
    if small_enough(layout, 64, LAYOUT_LIMIT):
        layout = F.broadcast(layout)
    share = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key, rest = [*by, "_part", "_chunk"], [c for c in points.columns if c not in (*by, "id")]

    def side(rows: DataFrame, which: int, who: str, by_part: Column, by_chunk: Column) -> DataFrame:
        placed = rows.join(layout, by).withColumn("_part", by_part).withColumn("_chunk", by_chunk)
        task = F.floor((F.col("_before") + (F.col("_part") * F.col("_chunks") + F.col("_chunk")) * F.col("_each")) / work).cast("int")
        return placed.select(*key, F.lit(which).alias("_side"), F.col(who).cast("bigint").alias("_who"), *rest, task.alias("_task"))

    met = side(points, 0, "id", share("id", "_parts"), every("_chunks")).unionByName(side(asks, 1, "qid", every("_parts"), share("qid", "_chunks")))
    spread = met.repartitionById(total // work + 1, "_task").drop("_task").sortWithinPartitions(*key, "_side", "_who")
    return spread.mapInArrow(_unions(len(key), d, ready_of, name), f"qid bigint, `{name}` bigint")


def _once(asks: DataFrame, by: list[str], found) -> DataFrame:
    """``found(asks)``, in which only a query that asks in several groups can meet an id twice."""
    several = durable(asks.select("qid", *by).distinct().groupBy("qid").count().where("count > 1").select("qid"))
    if several.isEmpty():
        return found(asks)
    return found(asks.join(several, "qid", "left_anti")).unionByName(found(asks.join(several, "qid", "left_semi")).distinct())


def wide_candidates(lists: DataFrame, by: list[str], w: int | str, part: int = LIST_PART, work: int = WORK, name: str = "id") -> DataFrame:
    """(qid, ``name``): as :func:`candidates`, for windows that hold a good part of a list: a query visits all parts of its group, and no pair is shuffled."""
    ship_code(lists.sparkSession)
    counts = lists.groupBy(*by, "axis").agg(F.sum("is_point").alias("n"), F.sum(1 - F.col("is_point")).alias("asks"))
    layout = durable(counts.groupBy(*by).agg(F.max("n").alias("n"), F.max("asks").alias("asks")).where("n > 0 and asks > 0"))
    side = lambda which, who: lists.where(F.col("is_point") == which).select(*by, F.col("who").alias(who), "axis", "pos", _window(w).cast("bigint").alias("_w"))
    return _once(side(0, "qid"), by, lambda asks: _met(side(1, "id"), asks, layout, by, 0, _Placed, part, LIST_ASKS, work, name))


def scaled_candidates(points: DataFrame, asks: DataFrame, axes: DataFrame, by: list[str], share: float, least: int, d: int, whole: int = WHOLE, work: int = WORK, name: str = "id") -> DataFrame:
    """(qid, ``name``): what :func:`candidates` gives of the :func:`scaled` lists of points (by, id, vec) and asks (by, qid, vec).

    Rows must be usable; whole rows repeated count once.  A group of up to ``whole`` rows is sorted where its queries come, and no list of
    it is shuffled; larger groups go by sorted lists.  The result is too long for its columns to be renamed afterwards at no cost.
    """
    ship_code(points.sparkSession)
    points, asks = points.select(*by, "id", "vec"), asks.select(*by, "qid", "vec")
    layout = durable(points.groupBy(*by).agg(F.count("*").alias("n")).join(asks.groupBy(*by).agg(F.count("*").alias("asks")), by))
    a = np.array([v for _, v in axis_rows(axes)], np.float64)

    def found(asks: DataFrame) -> DataFrame:
        out = _met(points, asks, layout.where(F.col("n") <= whole), by, d, lambda ids, x: _Sorted(ids, x, a, share, least), whole, LEAST_ASKS, work, name)
        large = layout.where(F.col("n") > whole).select(*by)
        if large.isEmpty():
            return out
        own = durable(projections(points.join(large, by, "left_semi").distinct(), axes, "vec", d))
        lists = sorted_lists(own, projections(asks.join(large, by, "left_semi"), axes, "vec", d), by)
        return out.unionByName(wide_candidates(scaled(lists, by, share, least), [*by, "w"], "w", name=name))

    return _once(asks, by, found)


def _block_best(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> list[np.ndarray]:
    """(qid, id, squared distance) of each query's k best of the rows lo to hi of one block, by (distance, id)."""
    dist = (x * x).sum(1)[None] + (q * q).sum(1)[:, None] - 2.0 * (q @ x.T)
    place = np.arange(len(x))[None]
    dist = np.where((place >= lo[:, None]) & (place < hi[:, None]), dist, np.inf)
    if len(x) > k:
        kth = np.partition(dist, k - 1, axis=1)[:, k - 1]
        limit = np.where(np.isfinite(kth), kth + 1e-9 * (1.0 + np.abs(np.where(np.isfinite(kth), kth, 0.0))), np.inf)
        qi, xi = np.nonzero((dist <= limit[:, None]) & np.isfinite(dist))
    else:
        qi, xi = np.nonzero(np.isfinite(dist))
    exact = in_order(x[xi], q[qi])
    order = np.lexsort((ids[xi], exact, qi))
    qi, xi, exact = qi[order], xi[order], exact[order]
    keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return [qids[qi[keep]], ids[xi[keep]], exact[keep]]


def nearest_in_windows(lists: DataFrame, by: list[str], w: int | str, k: int, d: int, width: int | None = None) -> DataFrame:
    """(qid, id, sq): what can be among the k nearest of a query's windows over all axes, an id once at its nearest.

    ``lists`` carry ``vec``.  A sorted list lies in blocks of neighbouring places, a query comes to the blocks its window meets (two at most, or as
    many as its width needs), and a block hands on k rows per query: the windows' members are never written out as pairs.
    """
    ship_code(lists.sparkSession)
    width = width or (MOST_BLOCK if isinstance(w, str) else max(LEAST_BLOCK, min(MOST_BLOCK, 2 * w)))
    reach, group = _window(w).cast("bigint"), [*by, "axis"]
    at = F.col("pos")
    held = lists.where("is_point = 1").select(*group, F.floor(at / width).alias("block"), F.lit(0).alias("side"), "who", "pos", reach.alias("reach"), "vec")
    blocks = F.sequence(F.floor(F.greatest(at - reach, F.lit(0)) / width), F.floor((at + reach - 1) / width))
    asks = lists.where("is_point = 0").select(*group, F.explode(blocks).alias("block"), F.lit(1).alias("side"), "who", "pos", reach.alias("reach"), "vec")
    key = [*group, "block"]
    met = held.unionByName(asks).repartition(*key).sortWithinPartitions(*key, "side", "pos")
    m = len(key)
    schema = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("sq", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts, ready = None, [], None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys = [b.column(i).to_numpy(zero_copy_only=False) for i in range(m)]
            side, who, pos, far = (b.column(m + i).to_numpy(zero_copy_only=False) for i in range(4))
            x = matrix(b.column(m + 4), d)
            cuts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in keys], axis=0)] if n > 1 else [True])
            for a, z in zip(cuts.tolist(), np.r_[cuts[1:], n].tolist()):
                if (here := tuple(c[a] for c in keys)) != last:
                    last, parts, ready = here, [], None
                split = a + int((side[a:z] == 0).sum())
                if split > a:
                    parts.append((who[a:split], pos[a:split], x[a:split].astype(np.float64)))
                if split < z and parts:
                    ready = ready or tuple(np.concatenate(c) for c in zip(*parts))
                    ids, places, points = ready
                    step = max(1, _PAIRS // len(ids))
                    for c in range(split, z, step):
                        e = min(c + step, z)
                        out = _block_best(ids, points, who[c:e], x[c:e].astype(np.float64), pos[c:e] - far[c:e] - places[0], pos[c:e] + far[c:e] - places[0], k)
                        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    best = met.mapInArrow(run, "qid bigint, id bigint, sq double")
    return best.groupBy("qid", "id").agg(F.min("sq").alias("sq"))
