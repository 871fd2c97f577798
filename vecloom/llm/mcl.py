"""Clusters of mutually similar vectors by Markov clustering.

1. Links: every pair of listed vectors of an index within the squared distance ``radius_sq``, found exactly.  Vectors meet in the
   cell of their nearest checkpoint centroid; a vector also visits the cells beyond whose bisector a neighbour could
   lie.
2. Exact copies, and vectors with the same neighbourhood (each other included), act as one node with a weight: flow cannot
   tell them apart.  They are tied to one of them by a single link each, within their cell already, so the pairs of a
   dense group never leave it.
3. Flow: a column-stochastic sparse matrix is squared, inflated (entries to a power, columns rescaled) and pruned
   until it stands still.  A column's strongest row is its attractor; columns whose attractors lead to one another are a cluster,
   and the members of strongest flow are its typical ones.  A node that stands for ``w`` vectors has their joint flow; each of them
   has a ``w``-th of it, and inflation acts on that, so the clusters are those of the graph of all vectors.
4. Groups in the sense of linked vectors: clusters joined wherever a link crosses their border.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.operators.coarse import Cells, Prepared, centroid_rows, counted, lists, matrix, over_cells, usable_vectors
from vecloom.llm.rabitq import rotation
from vecloom.sources.tables import durable, last_checkpoints

#: Vectors a cell is counted to hold before it is cut into bands along one direction.
BAND_ROWS = 16_384
#: Width of a band in radii.
BAND_WIDTH = 4.0
INNER, HOME, VISITOR, TIE = 0, 1, 2, 3
PLACED = "index_id int, cluster int, band int, side int, id bigint, other bigint, vec array<float>"
LINKS = "a bigint, b bigint, copy int"
_CHUNK = 1_024


def listed_vectors(vectors: DataFrame, checkpoints: DataFrame, clusters: DataFrame, d: int) -> DataFrame:
    """(index_id, id, vec): usable vectors listed in their index's last complete checkpoint."""
    last = last_checkpoints(checkpoints).select("index_id", "checkpoint_id")
    listed = clusters.select("checkpoint_id", "global_ids").join(last, "checkpoint_id").select("index_id", F.explode("global_ids").alias("id")).where("id is not null").distinct()
    return usable_vectors(vectors, d).join(listed, ["index_id", "id"], "left_semi")


def _place(radius: float):
    def visit(cells: Cells, index: int, ids: np.ndarray, x: np.ndarray) -> list:
        x = x.astype(np.float64)
        # copies within the batch leave as ties to one of them, so a vector repeated endlessly doesn't fill a cell
        order = np.lexsort((ids, *x.T[::-1]))
        fresh = np.r_[True, (x[order][1:] != x[order][:-1]).any(1)]
        lead = ids[order][np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        tied, head = order[~fresh & (lead != ids[order])], lead[~fresh & (lead != ids[order])]
        own, points = ids[order[fresh]], x[order[fresh]]
        dist = cells.distances(points)
        home = dist.argmin(1)
        along = points @ rotation(points.shape[1])[:, 0] / np.linalg.norm(rotation(points.shape[1])[:, 0])
        width = BAND_WIDTH * radius
        banded = cells.sizes > BAND_ROWS
        bands = lambda cell, at: np.where(banded[cell], np.floor(at / width), 0).astype(np.int32)
        cols = []
        # the next band of the same cell, if a neighbour may lie there
        up = np.flatnonzero(banded[home] & (bands(home, along + radius * 1.000001) > bands(home, along)))
        down = np.flatnonzero(banded[home] & (bands(home, along - radius * 1.000001) < bands(home, along)))
        cols.append((home[up], bands(home[up], along[up]) + 1, np.full(len(up), VISITOR, np.int32), up))
        # cells of greater number whose border with the home cell is within the radius
        apart = np.sqrt(((cells.centroids[:, None] - cells.centroids[None]) ** 2).sum(2))
        near = dist - dist[np.arange(len(own)), home][:, None] <= 2.0 * radius * apart[home] * 1.000001 + 1e-9
        near[np.arange(len(own)), home] = False
        # who has no neighbour outside the cell knows its whole neighbourhood there
        kind = np.where(near.any(1), HOME, INNER).astype(np.int32)
        kind[up] = kind[down] = HOME
        cols.insert(0, (home, bands(home, along), kind, np.arange(len(own))))
        near &= np.arange(len(cells.clusters))[None] > home[:, None]
        who, cell = np.nonzero(near)
        first, last = bands(cell, along[who] - radius * 1.000001), bands(cell, along[who] + radius * 1.000001)
        for shift in range(int((last - first).max(initial=0)) + 1):
            at = first + shift <= last
            cols.append((cell[at], (first + shift)[at], np.full(int(at.sum()), VISITOR, np.int32), who[at]))
        cell, band, side, who = (np.concatenate(c) for c in zip(*cols))
        n, m = len(who), len(tied)
        vectors = pa.concat_arrays([lists(points[who]), lists(np.zeros((m, points.shape[1]), np.float32))])
        return [
            np.full(n + m, index, np.int32), np.r_[cells.clusters[cell], np.full(m, -2, np.int32)], np.r_[band, (ids[tied] % 64).astype(np.int32)],
            np.r_[side, np.full(m, TIE, np.int32)], np.r_[own[who], ids[tied]], np.r_[own[who], head], vectors,
        ]

    return visit


def near_pairs(a: np.ndarray, b: np.ndarray | None, limit: float, along: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of ``a`` and ``b`` (of ``a`` and later rows of ``a`` if None) within ``limit``, squared.

    Both are sorted along one direction first, so a row meets only rows within the radius on it.  Distances from the matrix product decide;
    only those within rounding of the limit are summed again element by element.
    """
    radius = np.sqrt(limit) * 1.000001
    pa_ = a @ along
    oa = np.argsort(pa_, kind="stable")
    other = a if b is None else b
    pb = other @ along
    ob = oa if b is None else np.argsort(pb, kind="stable")
    sa, sb, ka, kb = a[oa], other[ob], pa_[oa], pb[ob]
    na, nb = (sa * sa).sum(1), (sb * sb).sum(1)
    rounding = 1e-7 + 1e-12 * (na.max(initial=0.0) + nb.max(initial=0.0))
    for i in range(0, len(sa), _CHUNK):
        j = min(i + _CHUNK, len(sa))
        first = i if b is None else int(np.searchsorted(kb, ka[i] - radius))
        end = int(np.searchsorted(kb, ka[j - 1] + radius, "right"))
        for f in range(first, end, 2 * _CHUNK):
            e = min(f + 2 * _CHUNK, end)
            dist = na[i:j, None] + nb[f:e] - 2.0 * (sa[i:j] @ sb[f:e].T)
            x, y = np.nonzero(dist <= limit + rounding)
            if b is None:
                later = x + i < y + f
                x, y = x[later], y[later]
            sure = dist[x, y] <= limit - rounding
            x, y = x + i, y + f
            edge = np.flatnonzero(~sure)
            sure[edge] = ((sa[x[edge]] - sb[y[edge]]) ** 2).sum(1) <= limit
            yield oa[x[sure]], ob[y[sure]]


def _scrambled(ids: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of ids."""
    z = ids.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _gather_hood(count: np.ndarray, hood: np.ndarray, at: np.ndarray, other: np.ndarray) -> None:
    """Add neighbours ``other`` to the neighbourhoods of the rows ``at``, in place."""
    if not len(at):
        return
    order = np.argsort(at, kind="stable")
    at, other = at[order], other[order]
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    count[at[starts]] += np.diff(np.r_[starts, len(at)])
    for k in (0, 1):
        hood[k, at[starts]] ^= np.bitwise_xor.reduceat(_scrambled(other, k + 1), starts)


def _link(d: int, limit: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("copy", pa.int32())])
    along = rotation(d)[:, 1] / np.linalg.norm(rotation(d)[:, 1])

    def rows(a: np.ndarray, b: np.ndarray, copy: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), copy, np.int32))], schema=schema)

    def cell(homes: list, visitors: list) -> Iterator[pa.RecordBatch]:
        ids, x, inner = (np.concatenate(c) for c in zip(*homes))
        x = x.astype(np.float64)
        order = np.lexsort((ids, *x.T[::-1]))
        ids, x, inner = ids[order], x[order], inner[order]
        fresh = np.r_[True, (x[1:] != x[:-1]).any(1)]
        leader = np.cumsum(fresh) - 1
        member, ids, x, inner = ids, ids[fresh], x[fresh], inner[fresh]
        v_ids, v = (np.concatenate(c) for c in zip(*visitors)) if visitors else (np.zeros(0, np.int64), np.zeros((0, d), np.float32))
        v = v.astype(np.float64)

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """(home, home or -1, id of the other) of every pair with a home."""
            for i, j in near_pairs(x, None, limit, along):
                yield i, j, ids[j]
            if len(v):
                for i, j in near_pairs(x, v, limit, along):
                    other = ids[i] != v_ids[j]
                    yield i[other], np.full(int(other.sum()), -1), v_ids[j[other]]

        # neighbourhoods as two hashes: inner vectors with the same one, themselves included, are tied to one of them
        count = np.ones(len(ids), np.int64)
        hood = np.stack([_scrambled(ids, 1), _scrambled(ids, 2)])
        for i, j, other in pairs():
            _gather_hood(count, hood, i, other)
            back = j >= 0
            _gather_hood(count, hood, j[back], ids[i[back]])
        own = np.where(inner, -1, np.arange(len(ids)))  # others stay by themselves
        order = np.lexsort((ids, hood[1], hood[0], count, own))
        alike = (own[order][1:] == -1) & (own[order][1:] == own[order][:-1])
        alike &= (count[order][1:] == count[order][:-1]) & (hood[:, order][:, 1:] == hood[:, order][:, :-1]).all(0)
        first = np.r_[True, ~alike]
        lead = np.empty(len(ids), np.int64)
        lead[order] = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
        to = ids[lead[leader]]
        tied = to != member
        if tied.any():
            yield rows(to[tied], member[tied], 1)
        size = np.bincount(lead, minlength=len(ids))
        head = lead == np.arange(len(ids))
        if (head & (count > size)).any():  # else every neighbourhood is one set of ties
            for i, j, other in pairs():
                keep = head[i] & np.where(j >= 0, head[np.maximum(j, 0)], True)
                if keep.any():
                    yield rows(ids[i[keep]], other[keep], 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes, visitors = None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            index, cluster, band, side, ids, other = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            x = matrix(b.column(6), d)
            cuts = np.flatnonzero(np.r_[True, (index[1:] != index[:-1]) | (cluster[1:] != cluster[:-1]) | (band[1:] != band[:-1])])
            for a, z in zip(cuts.tolist(), np.r_[cuts[1:], len(index)].tolist()):
                if (here := (int(index[a]), int(cluster[a]), int(band[a]))) != key:
                    if homes:
                        yield from cell(homes, visitors)
                    key, homes, visitors = here, [], []
                if cluster[a] == -2:
                    yield rows(other[a:z], ids[a:z], 1)
                    continue
                split = a + int((side[a:z] <= HOME).sum())
                if split > a:
                    homes.append((ids[a:split], x[a:split].copy(), side[a:split] == INNER))
                if split < z:
                    visitors.append((ids[split:z], x[split:z].copy()))
        if homes:
            yield from cell(homes, visitors)

    return run


def links(rows: DataFrame, centroids: DataFrame | Prepared, radius_sq: float = 2.0, d: int = 32) -> DataFrame:
    """(a, b, copy): the links between the vectors of ``rows`` (index_id, id, vec); no index links to another.

    ``copy`` 1: b is tied to a, being an exact copy of it or having the same neighbourhood; b's links are a's.  A tie's a may
    itself be tied, once.  ``copy`` 0: within the radius.  No link is missing, only ties stand for many.
    """
    placed = over_cells(rows, centroids, d, _place(float(np.sqrt(radius_sq))), PLACED)
    met = placed.repartition("index_id", "cluster", "band").sortWithinPartitions("index_id", "cluster", "band", "side")
    return met.mapInArrow(_link(d, radius_sq), LINKS)


def twins(edges: DataFrame) -> DataFrame:
    """(node, twin): nodes with the same closed neighbourhood share ``twin``, the smallest of them.

    Neighbourhoods compare by size and two independent 64-bit hashes.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near"))).distinct()
    hood = both.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("near")).alias("h1"), F.bit_xor(F.xxhash64(F.lit("second"), "near")).alias("h2"))
    closed = hood.select("node", "n", F.col("h1").bitwiseXOR(F.xxhash64("node")).alias("h1"), F.col("h2").bitwiseXOR(F.xxhash64(F.lit("second"), "node")).alias("h2"))
    smallest = closed.groupBy("n", "h1", "h2").agg(F.min("node").alias("twin"))
    return closed.join(smallest, ["n", "h1", "h2"]).select("node", "twin")


def quotient(edges: DataFrame, twin: DataFrame) -> DataFrame:
    """Distinct links (a < b) between the representatives of twins."""
    left = twin.select(F.col("node").alias("a"), F.col("twin").alias("ta"))
    right = twin.select(F.col("node").alias("b"), F.col("twin").alias("tb"))
    mapped = edges.join(left, "a").join(right, "b").where("ta <> tb")
    return mapped.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()


def markov_flow(edges: DataFrame, weights: DataFrame, inflation: float = 2.0, prune: float = 1e-3, still: float = 1e-3, most: int = 500) -> DataFrame:
    """The limit (col, row, flow) of expansion, inflation and pruning on links (a, b) with node weights (node, weight).

    A column keeps entries of at least ``prune``; one that has none keeps its strongest 1/prune, smaller rows first.  Each
    round is one join on the inner index and two aggregations; the matrix is cut from its lineage every round.
    Stops when in every column the flow is even among the attractors (to within ``still``), or when a matrix comes again (a flow that
    swings); RuntimeError if neither happens in ``most`` rounds.
    """
    loops = weights.select(F.col("node").alias("col"), F.col("node").alias("row"))
    entries = edges.select(F.col("a").alias("col"), F.col("b").alias("row")).unionByName(edges.select(F.col("b").alias("col"), F.col("a").alias("row"))).unionByName(loops)
    weighted = entries.join(weights.select(F.col("node").alias("row"), F.col("weight").cast("double").alias("w")), "row").select("col", "row", F.col("w").alias("flow"), "w")
    column = W.partitionBy("col")

    def scaled(m: DataFrame) -> DataFrame:
        return m.withColumn("flow", F.col("flow") / F.sum("flow").over(column))

    def pruned(m: DataFrame) -> DataFrame:
        topped = m.withColumn("_top", F.max("flow").over(column))
        plain = topped.where((F.col("_top") >= prune) & (F.col("flow") >= prune))
        order = F.row_number().over(column.orderBy(F.desc("flow"), "row"))
        faint = topped.where(F.col("_top") < prune).withColumn("_r", order).where(F.col("_r") <= int(1 / prune)).drop("_r")
        return plain.unionByName(faint).drop("_top")

    m, seen = durable(scaled(pruned(scaled(weighted)))), set()
    for _ in range(most):
        left = m.select(F.col("col").alias("k"), "row", F.col("flow").alias("f1"), "w")
        right = m.select("col", F.col("row").alias("k"), F.col("flow").alias("f2"))
        squared = left.join(right, "k").groupBy("col", "row").agg(F.sum(F.col("f1") * F.col("f2")).alias("flow"), F.max("w").alias("w"))
        inflated = squared.withColumn("flow", F.pow("flow", F.lit(inflation)) * F.pow("w", F.lit(1.0 - inflation)))
        m = durable(scaled(pruned(scaled(inflated))))
        mark = F.bit_xor(F.xxhash64("col", "row", F.round("flow", 6))).alias("mark")
        uneven = m.groupBy("col").agg((F.max("flow") - F.sum(F.col("flow") * F.col("flow"))).alias("c"), F.count("*").alias("n"), mark)
        chaos, *now = uneven.agg(F.max("c"), F.sum("n"), F.bit_xor("mark")).first()
        if chaos is None or chaos < still or tuple(now) in seen:
            return m.select("col", "row", "flow")
        seen.add(tuple(now))
    raise RuntimeError(f"the flow did not settle in {most} rounds")


def attractors(flow: DataFrame) -> DataFrame:
    """(node, cluster, strength): each column's strongest row, and the cluster it leads to: columns connected through their strongest rows.

    Among equally strong rows the smallest id wins.  A cluster is named by its smallest node.
    """
    strongest = F.max(F.struct(F.round("flow", 9).alias("flow"), (-F.col("row")).alias("neg"))).alias("best")
    best = durable(flow.groupBy("col").agg(strongest).select(F.col("col").alias("node"), (-F.col("best.neg")).alias("row"), F.col("best.flow").alias("strength")))
    root = joined(best.select(F.col("node").alias("a"), F.col("row").alias("b")))
    return best.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("cluster"), "strength")


def joined(pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node connected with each node of the links (a, b), by alternating stars until nothing changes.

    Nodes without a link to another are in no row.
    """
    edges = durable(pairs.select("a", "b").where("a <> b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").distinct()  # a > b in every row
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b")))
        edges = durable(small.distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


class Clustering:
    """Markov clusters of linked vectors, with the tables all results come from.

    ``members``: (global_id, node, cluster, strength) of every vector with a link, copies included; ``crossing``: links
    between clusters.
    """

    def __init__(self, found: DataFrame, inflation: float = 2.0, prune: float = 1e-3):
        self.links = found = durable(found)
        edges = found.where("copy = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        first = found.where("copy = 1").select(F.col("b").alias("global_id"), F.col("a").alias("node"))
        second = first.select(F.col("global_id").alias("node"), F.col("node").alias("head"))
        ties = durable(first.join(second, "node", "left").select("global_id", F.coalesce("head", "node").alias("node")))
        twin = durable(twins(edges))
        lean = durable(quotient(edges, twin))
        moved = lean.select(F.col("a").alias("twin")).unionByName(lean.select(F.col("b").alias("twin"))).distinct()
        tied = ties.groupBy("node").agg(F.count("*").alias("tied"))
        weights = twin.join(moved, "twin", "left_semi").join(tied, "node", "left").groupBy(F.col("twin").alias("node")).agg(F.sum(1 + F.coalesce("tied", F.lit(0))).alias("weight"))
        label = durable(attractors(markov_flow(lean, weights, inflation, prune)))
        nodes = twin.join(label.withColumnRenamed("node", "twin"), "twin", "left").select("node", F.coalesce("cluster", "twin").alias("cluster"), F.coalesce("strength", F.lit(1.0)).alias("strength"))
        alone = ties.select("node").distinct().join(twin.select("node"), "node", "left_anti").select("node", F.col("node").alias("cluster"), F.lit(1.0).alias("strength"))
        self.nodes = nodes.unionByName(alone)
        everyone = self.nodes.select(F.col("node").alias("global_id"), "node").unionByName(ties)
        self.members = everyone.join(self.nodes, "node").select("global_id", "node", "cluster", "strength")
        name = label.select("node", "cluster")
        self.crossing = (
            lean.join(name.select(F.col("node").alias("a"), F.col("cluster").alias("ca")), "a")
            .join(name.select(F.col("node").alias("b"), F.col("cluster").alias("cb")), "b")
            .where("ca <> cb")
            .select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        )

    def groups(self) -> DataFrame:
        """(group_id, global_id): clusters joined over crossing links; named by their smallest member."""
        root = joined(self.crossing).select(F.col("node").alias("cluster"), "root")
        least = self.members.groupBy("cluster").agg(F.min("global_id").alias("least"))
        rooted = durable(least.join(root, "cluster", "left").select("cluster", "least", F.coalesce("root", "cluster").alias("root")))
        named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("group_id")), "root").select("cluster", "group_id")
        return self.members.join(named, "cluster").select("group_id", "global_id").distinct()

    def described(self, typical: int = 3) -> DataFrame:
        """(cluster_id, size, typical): size counts copies; the typical members are those of strongest flow, smaller ids first."""
        sizes = self.members.groupBy("cluster").agg(F.countDistinct("global_id").alias("size"), F.min("global_id").alias("cluster_id"))
        rank = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("strength"), "node"))
        top = self.nodes.withColumn("r", rank).where(F.col("r") <= typical).groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("r", "node"))).alias("t"))
        return sizes.join(top, "cluster").select("cluster_id", "size", F.col("t.node").alias("typical"))


def similar_groups(vectors: DataFrame, checkpoints: DataFrame, clusters: DataFrame, radius_sq: float = 2.0, d: int = 32) -> Clustering:
    """Cluster the vectors listed in the last complete checkpoints; see :class:`Clustering`.

    Unusable and unlisted vectors, and vectors without a link, are in no cluster.  Repeated rows count once.
    """
    cells = counted(usable_vectors(vectors, d), centroid_rows(checkpoints, clusters, d), d)
    return Clustering(links(listed_vectors(vectors, checkpoints, clusters, d), cells, radius_sq, d))
