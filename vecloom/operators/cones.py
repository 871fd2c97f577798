"""Cones: inside a cluster every vector joins the directions its centred self points along."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators.coarse import Cells, Prepared, double_lists, in_order_dots, int_lists, lists, over_cells

#: Members of a cluster from which it is laid out in several parts, by a hash of the id.
PART_ROWS = 65_536


def _scores(centred: np.ndarray, dots: np.ndarray) -> np.ndarray:
    total = np.zeros(len(centred))
    for j in range(centred.shape[1]):
        total += centred[:, j] * centred[:, j]
    norm = np.sqrt(total)
    return np.abs(dots) / np.where(norm < 1e-10, 1.0, norm)[:, None]


def _ranked(scores: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` best axes of each row, ties by the smaller axis."""
    return np.argsort(-scores, axis=1, kind="stable")[:, :top]


class Directions:
    """The axes of an index: one list for all clusters, and lists of their own for some, by (index_id, cluster).

    All lists name the same number of axes by the same numbers.
    """

    def __init__(self, axes: list[tuple[int, list[float]]], own: dict[tuple[int, int], list[list[float]]] | None = None):
        self.names = np.array([f for f, _ in axes], np.int32)
        self.common = np.array([v for _, v in axes], np.float64)
        self.own = {key: np.array(v, np.float64) for key, v in (own or {}).items()}

    def dots(self, centred: np.ndarray, index: int, clusters: np.ndarray) -> np.ndarray:
        """Products of centred rows with the axes of their clusters."""
        out = in_order_dots(centred, self.common)
        for c in np.unique(clusters).tolist() if self.own else ():
            if (axes := self.own.get((index, c))) is not None:
                out[clusters == c] = in_order_dots(centred[clusters == c], axes)
        return out


def directions(axes) -> Directions:
    return axes if isinstance(axes, Directions) else Directions(axes)


def _parts(cells: Cells) -> np.ndarray:
    """Parts of each cell, from the counted sizes."""
    return np.maximum(1, -(-cells.sizes // PART_ROWS))


def in_parts(rows: DataFrame) -> DataFrame:
    """Members with the ``part`` of their cluster that they lie in, of ``parts``."""
    return rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")


MEMBERS = "index_id int, cluster int, parts int, fans array<int>, id bigint, scores array<double>, proj array<double>, vec array<float>"


def members(rows: DataFrame, centroids: DataFrame | Prepared, axes, top: int = 2, d: int = 32) -> DataFrame:
    """(index_id, cluster, fans, id, scores, proj, vec, part): each row once, in its nearest cluster, with its ``top`` cones.

    ``proj`` are the centred projections on all axes, ``scores`` those of the cones in ``fans``, best first.  Single members have cones
    like everyone, so nothing is unreachable.  A cluster counted to be larger than ``PART_ROWS`` stands in several parts.
    """
    given = directions(axes)

    def visit(cells: Cells, index: int, ids: np.ndarray, x: np.ndarray) -> list:
        x = x.astype(np.float64)
        home = cells.distances(x).argmin(1)
        centred = x - cells.centroids[home]
        dots = given.dots(centred, index, cells.clusters[home])
        score = _scores(centred, dots)
        best = _ranked(score, top)
        parts = _parts(cells)[home].astype(np.int32)
        return [np.full(len(ids), index, np.int32), cells.clusters[home], parts, int_lists(given.names[best]), ids, double_lists(np.take_along_axis(score, best, 1)), double_lists(dots), lists(x)]

    return in_parts(over_cells(rows, centroids, d, visit, MEMBERS))


def by_cone(rows: DataFrame) -> DataFrame:
    """(index_id, cluster, fan, id, score, proj, vec): a row per cone of each of ``members``."""
    each = rows.select("index_id", "cluster", "id", "proj", "vec", F.explode(F.arrays_zip("fans", "scores")).alias("z"))
    return each.select("index_id", "cluster", F.col("z.fans").alias("fan"), "id", F.col("z.scores").alias("score"), "proj", "vec")


def entries(rows: DataFrame, centroids: DataFrame | Prepared, axes, top: int = 2, d: int = 32) -> DataFrame:
    """(index_id, cluster, fan, id, score, proj, vec): each row in the ``top`` cones of its nearest cluster."""
    return by_cone(members(rows, centroids, axes, top, d))


VISITS = "index_id int, cluster int, part int, fans array<int>, qid bigint, scores array<double>, q_proj array<double>, q array<float>, cluster_rank int"


def visits(queries: DataFrame, centroids: DataFrame | Prepared, axes, clusters: int, fans: int, d: int = 32) -> DataFrame:
    """(index_id, cluster, part, fans, qid, scores, q_proj, q, cluster_rank): where each query goes, a row per part of a visited cluster.

    The ``clusters`` nearest filled clusters (ties by number), and in each the ``fans`` axes of greatest score for the query centred there.
    """
    given = directions(axes)

    def visit(cells: Cells, index: int, ids: np.ndarray, x: np.ndarray) -> list:
        x = x.astype(np.float64)
        dist = cells.distances(x)
        if (cells.counts > 0).any():
            dist = np.where(cells.counts > 0, dist, np.inf)
        near = np.argsort(dist, axis=1, kind="stable")[:, :clusters]
        who, cell = np.repeat(np.arange(len(ids)), near.shape[1]), near.ravel()
        place = np.tile(np.arange(1, near.shape[1] + 1, dtype=np.int32), len(ids))
        there = np.isfinite(dist[who, cell])
        parts = _parts(cells)[cell] * there
        turn = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        who, cell, place = np.repeat(who, parts), np.repeat(cell, parts), np.repeat(place, parts)
        centred = x[who] - cells.centroids[cell]
        dots = given.dots(centred, index, cells.clusters[cell])
        score = _scores(centred, dots)
        best = _ranked(score, fans)
        return [
            np.full(len(who), index, np.int32), cells.clusters[cell], turn.astype(np.int32), int_lists(given.names[best]), ids[who],
            double_lists(np.take_along_axis(score, best, 1)), double_lists(dots), lists(x[who]), place,
        ]

    return over_cells(queries, centroids, d, visit, VISITS)


def probes(queries: DataFrame, centroids: DataFrame | Prepared, axes, clusters: int, fans: int, d: int = 32) -> DataFrame:
    """(index_id, qid, cluster, cluster_rank, fan, fan_rank, score, q_proj, q): the cones each query visits, a row for each."""
    once = visits(queries, centroids, axes, clusters, fans, d).where("part = 0")
    each = once.select("index_id", "qid", "cluster", "cluster_rank", "q_proj", "q", F.posexplode(F.arrays_zip("fans", "scores")).alias("turn", "z"))
    return each.select("index_id", "qid", "cluster", "cluster_rank", F.col("z.fans").alias("fan"), (F.col("turn") + 1).alias("fan_rank"), F.col("z.scores").alias("score"), "q_proj", "q")


def sizes(cone_entries: DataFrame) -> DataFrame:
    """(index_id, cluster, fan, n): live members of each cone."""
    return cone_entries.groupBy("index_id", "cluster", "fan").agg(F.count("*").alias("n"))
