"""The index as an object: build it from a DataFrame, search it, change it, save it.

Everything inside is a table.  Members lie in segments, one per batch of changes; a table of replaced and deleted ids says up to which batch a
member no longer counts, and now and then all segments become one.  So a batch writes what it brings, never what was there.  Within a
batch members are assigned against the centroids as they are, which then move.  Searches write nothing but their layout's counts.
Methods that change the index replace its tables; readers of older DataFrames are not disturbed.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.functions import vecmath as V
from vecloom.operators import coarse, cones, exact, maintain, projection, search, tuner
from vecloom.operators.coarse import lloyd
from vecloom.sources.store import Collection, Numbered
from vecloom.sources.tables import durable, small_enough

#: Rows k-means is fitted on at most (fixed value of the index).
SAMPLE = 50_000
#: Segments kept before they become one.
SEGMENTS = 16
GONE = "id bigint, batch int, deleted boolean, cluster int"


@dataclass(frozen=True)
class Params:
    d: int
    nlist: int
    fans: int
    cone_top_k: int = 1
    metric: str = "l2"
    seed: int = 0
    merge_eps: float = 1.0
    merge_ratio: float = 0.5
    merge_interval: int = 0  # inserts after which clusters are merged; 0: only when asked
    drift_angle: float = 15.0
    compact_at: float = maintain.COMPACT_AT

    def __post_init__(self) -> None:
        if self.merge_eps <= 0 or not 0 <= self.merge_ratio <= 1 or self.merge_interval < 0:
            raise ValueError("merge_eps must be positive, merge_ratio within 0 and 1, merge_interval not negative")


def _rows(vectors: DataFrame, d: int, metric: str) -> DataFrame:
    """(index_id, id, vec) of usable rows, normalised for cosine, repeated rows once."""
    good = vectors.where(F.col("id").isNotNull() & V.usable("vec", d)).select(F.lit(0).alias("index_id"), F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<float>").alias("vec")).distinct()
    return good.withColumn("vec", V.normalise("vec").cast("array<float>")) if metric == "cosine" else good


class FanIndex:
    """Clusters and cones over (id, vec); see :meth:`fit`.

    ``own``: axes of clusters that were refreshed after a drift, by cluster (fans x d numbers each, on the driver).
    """

    def __init__(self, spark: SparkSession, params: Params, axes: list[tuple[int, list[float]]], cells: DataFrame, segments: list[DataFrame], gone: DataFrame, drift: DataFrame, own: dict[int, list[list[float]]], log: Collection | None = None):
        self.spark, self.params, self.axes, self.cells, self.segments = spark, params, axes, cells, segments
        self.gone, self.drift, self.own, self.log, self._inserted, self._batch = gone, drift, own, log, 0, 1_000_000

    # building

    @classmethod
    def fit(cls, vectors: DataFrame, d: int, nlist: int | None = None, fans: int = 16, cone_top_k: int = 1, metric: str = "l2", seed: int = 0, sampling: str = "random", log: Collection | None = None, **more) -> FanIndex:
        """Build from (id, vec).  ``nlist`` defaults to max(16, sqrt(n)) and is at most n; fans are at most ``d``.

        k-means is fitted on the driver on at most SAMPLE rows: those of smallest hash, or with ``sampling`` "head" those of smallest id, as a
        builder that reads chunk by chunk would take them; every row is then assigned and indexed.  Changes go to ``log`` first, if given.
        """
        kind = V.metric_name(metric)
        spark, rows = vectors.sparkSession, durable(_rows(vectors, d, kind))
        n = rows.count()
        if not n:
            raise ValueError("there are no usable vectors to build from")
        fans = min(fans, d)
        nlist = min(nlist or max(16, math.isqrt(n)), n)
        order = ["id"] if sampling == "head" else [F.xxhash64("id"), "id"]
        sample = rows.orderBy(*order).limit(max(SAMPLE, nlist)).select("vec").collect()
        mu = lloyd(np.array([r[0] for r in sample], float), min(nlist, len(sample)), seed, kind == "cosine")
        params = Params(d, len(mu), fans, min(cone_top_k, fans), kind, seed, **more)
        axes = [(i, a.tolist()) for i, a in enumerate(projection.random_axes(fans, d, seed, orthonormal=True))]
        cells = spark.createDataFrame([(0, c, [float(v) for v in m], 1) for c, m in enumerate(mu)], "index_id int, cluster int, mu array<double>, stated bigint")
        index = cls.assembled(spark, params, axes, cells, [], log)
        index.segments = [index._laid(rows, 0)]
        index._recount()
        return index

    @classmethod
    def assembled(cls, spark: SparkSession, params: Params, axes, cells: DataFrame, segments: list[DataFrame], log: Collection | None = None) -> FanIndex:
        """An index of ready tables: ``cells`` (index_id, cluster, mu, stated) and segments as ``cones.members`` gives them, with ``batch``."""
        from vecloom.streaming.drift import STATE

        return cls(spark, params, axes, cells, segments, spark.createDataFrame([], GONE), spark.createDataFrame([], STATE), {}, log)

    def _centroids(self) -> coarse.Prepared:
        return coarse.prepare(self.cells.select("index_id", "cluster", "mu", "stated"), self.params.d)

    def _directions(self) -> cones.Directions:
        return cones.Directions(self.axes, {(0, c): axes for c, axes in self.own.items()})

    def _laid(self, rows: DataFrame, batch: int) -> DataFrame:
        """A segment of ``rows``: one row per vector, with its cluster, cones and projections."""
        laid = cones.members(rows, self._centroids(), self._directions(), self.params.cone_top_k, self.params.d)
        return durable(laid.drop("part").withColumn("batch", F.lit(batch)))

    def _everything(self) -> DataFrame:
        rows = self.segments[0]
        for s in self.segments[1:]:
            rows = rows.unionByName(s)
        return rows

    def _live(self) -> DataFrame:
        """Members that count, in the parts that the present sizes of their clusters ask for."""
        upto = self.gone.groupBy("id").agg(F.max("batch").alias("upto"))
        rows = self._everything()
        live = rows.join(upto, (rows["id"] == upto["id"]) & (rows["batch"] < upto["upto"]), "left_anti")
        parts = self.cells.select("index_id", "cluster", F.greatest(F.lit(1), F.ceil(F.col("stated") / cones.PART_ROWS)).cast("int").alias("parts"))
        return cones.in_parts(live.join(F.broadcast(parts) if small_enough(parts, 24, 4 * 2**20) else parts, ["index_id", "cluster"]))

    def members(self) -> DataFrame:
        """(index_id, cluster, id, vec) of live vectors."""
        return self._live().select("index_id", "cluster", "id", "vec")

    def _recount(self) -> None:
        """Live counts of every cell; empty ones keep their place but are passed over in searches."""
        n = self.members().groupBy("index_id", "cluster").agg(F.count("*").alias("n"))
        cells = self.cells.drop("stated").join(n, ["index_id", "cluster"], "left").withColumn("stated", F.coalesce("n", F.lit(0)).cast("bigint")).drop("n")
        self.cells = durable(cells)

    # reading

    def _asks(self, queries: DataFrame) -> DataFrame:
        rows = queries.where(F.col("qid").isNotNull() & V.usable("q", self.params.d)).select(F.lit(0).alias("index_id"), F.col("qid").alias("id"), F.col("q").cast("array<float>").alias("vec"))
        return rows.withColumn("vec", V.normalise("vec").cast("array<float>")) if self.params.metric == "cosine" else rows

    def _visits(self, queries: DataFrame, probes: int, fan_probes: int) -> DataFrame:
        return cones.visits(self._asks(queries), self._centroids(), self._directions(), probes, min(fan_probes, self.params.fans), self.params.d)

    def candidates(self, queries: DataFrame, window: int = 50, probes: int = 10, fan_probes: int = 2) -> DataFrame:
        """(qid, id): live vectors within the window in the visited cones; all members of the clusters if every cone is visited."""
        return search.candidates(self._live(), self._visits(queries, probes, fan_probes), window, self.params.d, whole=fan_probes >= self.params.fans)

    def search(self, queries: DataFrame, k: int = 10, window: int = 200, probes: int = 10, fan_probes: int = 2, sketch: bool = False) -> DataFrame:
        """(qid, rank, id, dist): the k nearest of the visited cones, by (distance, id); windows grow as far as needed.

        ``sketch``: one window, refined through the lower bound of the axes' projections.
        """
        own = np.array([a for _, a in self.axes]) if sketch else None
        found = search.adaptive(self._live(), self._visits(queries, probes, fan_probes), k, window, self.params.d, whole=fan_probes >= self.params.fans, sketch=own)
        return found.select("qid", "rank", "id", V.from_sq("sq", self.params.metric).alias("dist"))

    def sketch(self) -> DataFrame:
        """(id, sketch): projections of live vectors on the axes."""
        rows = projection.projections(self.members().select("id", "vec"), projection.axis_table(self.spark, np.array([a for _, a in self.axes])), "vec", self.params.d, "sketch")
        return rows.select("id", "sketch")

    def describe(self) -> dict:
        """Parameters, and how many vectors, dead ids and filled clusters there are."""
        filled = self.cells.where("stated > 0").count()
        return asdict(self.params) | {"n": self.members().count(), "n_deleted": self.dead().count(), "filled": filled}

    def dead(self) -> DataFrame:
        """(id, cluster): deleted ids that no refresh has dropped yet."""
        last = self.gone.groupBy("id").agg(F.max(F.struct("batch", "deleted", "cluster")).alias("s"))
        return last.where("s.deleted").select("id", F.col("s.cluster").alias("cluster"))

    def _known(self, cluster: int, fan: int = 0) -> None:
        if not 0 <= fan < self.params.fans or not self.cells.where(F.col("cluster") == cluster).limit(1).count():
            raise IndexError(f"there is no cone {fan} of cluster {cluster}")

    def cluster_members(self, cluster: int) -> DataFrame:
        self._known(cluster)
        return self.members().where(F.col("cluster") == cluster).select("id", "vec")

    def cone(self, cluster: int, fan: int) -> DataFrame:
        """(id, score, proj) of a cone's live members."""
        self._known(cluster, fan)
        return cones.by_cone(self._live()).where((F.col("cluster") == cluster) & (F.col("fan") == fan)).select("id", "score", "proj")

    def point_cones(self, ids: DataFrame) -> DataFrame:
        """(id, cluster, fan) of the cones that hold each of ``ids`` (id)."""
        return cones.by_cone(self._live().join(ids.select("id").distinct(), "id", "left_semi")).select("id", "cluster", "fan")

    def cluster_axes(self, cluster: int) -> list[list[float]]:
        """The axes of a cluster: its own after a refresh, else those of all."""
        return self.own.get(cluster, [a for _, a in self.axes])

    def tombstones(self) -> DataFrame:
        """(cluster, n, n_tomb): live members and dead ids of every cluster."""
        dead = self.dead().groupBy("cluster").agg(F.count("*").alias("n_tomb"))
        return self.cells.select("cluster", F.col("stated").alias("n")).join(dead, "cluster", "left").na.fill({"n_tomb": 0})

    # changing

    def set_merging(self, interval: int | None = None, eps: float | None = None, ratio: float | None = None) -> None:
        """Change when and what is merged; values out of range raise ValueError."""
        given = {"merge_interval": interval, "merge_eps": eps, "merge_ratio": ratio}
        self.params = replace(self.params, **{k: v for k, v in given.items() if v is not None})

    def _next(self) -> int:
        self._batch += 1
        return self._batch

    def _outdate(self, rows: DataFrame, batch: int, deleted: bool) -> None:
        """From ``batch`` on, earlier members of the ids of ``rows`` (id, cluster) don't count."""
        more = rows.select("id", F.lit(batch).alias("batch"), F.lit(deleted).alias("deleted"), "cluster")
        self.gone = durable(self.gone.unionByName(more))

    def _resize(self, left: DataFrame, came: DataFrame | None = None) -> None:
        """Counts after members (cluster) left and others (cluster, vec) came; centroids move to the mean of what they stood for and what came."""
        out = left.groupBy("cluster").agg(F.count("*").alias("out"))
        cells = self.cells.withColumnRenamed("mu", "mu1").join(out, "cluster", "left")
        if came is None:
            self.cells = durable(cells.select("index_id", "cluster", F.col("mu1").alias("mu"), (F.col("stated") - F.coalesce("out", F.lit(0))).alias("stated")))
            return
        means = maintain.means(came, ["cluster"], "vec").select("cluster", F.col("n").alias("n2"), F.col("mu").alias("mu2"))
        both = cells.join(means, "cluster", "left").withColumn("n1", F.col("stated").cast("double"))
        moved = F.zip_with("mu1", "mu2", lambda a, b: (F.col("n1") * a + F.col("n2") * b) / (F.col("n1") + F.col("n2")))
        mu = F.when(F.col("mu2").isNull(), F.col("mu1")).otherwise(moved).alias("mu")
        self.cells = durable(both.select("index_id", "cluster", mu, (F.col("stated") - F.coalesce("out", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("stated")))

    def add(self, vectors: DataFrame) -> None:
        """Insert (id, vec).  A known id is replaced.  Unusable vectors raise ValueError before anything changes.

        Clusters whose inserts drifted away from their axes are refreshed with axes of their own; after ``merge_interval`` inserts
        clusters are merged.
        """
        from vecloom.streaming import drift

        p = self.params
        if vectors.where(F.col("id").isNull() | ~V.usable("vec", p.d)).limit(1).count():
            raise ValueError(f"vectors must have an id and {p.d} elements, none null or NaN")
        if self.log:
            self.log.add(vectors.select(F.col("id").alias("global_id"), F.col("vec").alias("vector")))
        rows, batch = durable(_rows(vectors, p.d, p.metric)), self._next()
        fresh = self._laid(rows, batch)
        steps = drift.displacements(rows.withColumn("seq", F.col("id")), self._live(), self._centroids(), self._directions(), p.cone_top_k, p.d)
        self.drift = durable(drift.drift_states(steps, self.axes, p.drift_angle, before=self.drift))
        replaced = durable(self._live().join(rows.select("id"), "id", "left_semi").select("id", "cluster"))
        self._outdate(rows.select("id").join(replaced, "id", "left"), batch, False)
        self.segments = [*self.segments, fresh]
        self._resize(replaced, fresh.select("cluster", "vec"))
        self._inserted += rows.count()
        self._adopt([r["cluster"] for r in self.drift.where("drifted").select("cluster").collect()])
        if p.merge_interval and self._inserted >= p.merge_interval:
            self.merge()
        self._compact()

    def _adopt(self, drifted: list[int]) -> None:
        """Give drifted clusters the basis of their drift as axes, and lay their members out anew; their drift starts afresh."""
        if not drifted:
            return
        p = self.params
        for r in self.drift.where(F.col("cluster").isin(drifted)).select("cluster", "u").collect():
            self.own[r["cluster"]] = np.array(r["u"]).reshape(p.d, p.fans).T.tolist()
        self.drift = durable(self.drift.where(~F.col("cluster").isin(drifted)))
        self._relay(drifted)

    def _relay(self, clusters: list[int]) -> None:
        """Lay the members of ``clusters`` out anew, in the clusters that are nearest now."""
        rows, batch = durable(self.members().where(F.col("cluster").isin(clusters))), self._next()
        fresh = self._laid(rows.select("index_id", "id", "vec"), batch)
        self._outdate(rows.select("id", "cluster"), batch, False)
        self.segments = [*self.segments, fresh]
        self._recount()

    def _compact(self, now: bool = False) -> None:
        """Make one segment of all when there are many; members that don't count are gone then, tombstones stay known."""
        if now or len(self.segments) > SEGMENTS:
            self.segments = [durable(self._live().drop("part"))]
            dead = self.dead().select("id", F.lit(0).alias("batch"), F.lit(True).alias("deleted"), "cluster")
            self.gone = durable(dead)

    def delete(self, ids: DataFrame, strict: bool = False) -> None:
        """Delete (id); unknown and dead ids are no-ops, or IndexError if ``strict``."""
        known = self._live().select("id", "cluster")
        if strict and ids.select("id").join(known, "id", "left_anti").limit(1).count():
            raise IndexError("some ids are not in the index")
        if self.log:
            self.log.delete(ids.select(F.col("id").alias("global_id")))
        gone = durable(known.join(ids.select("id").distinct(), "id", "left_semi"))
        self._outdate(gone, self._next(), True)
        self._resize(gone)

    def update(self, vectors: DataFrame) -> None:
        self.add(vectors)

    def refresh(self) -> None:
        """Drop the tombstones of clusters in which they are at least the compaction share, and lay those clusters out anew."""
        share = F.col("n_tomb") / F.greatest(F.col("n") + F.col("n_tomb"), F.lit(1))
        due = [r["cluster"] for r in self.tombstones().where((F.col("n_tomb") > 0) & (share >= self.params.compact_at)).collect()]
        if due:
            self._relay(due)
            self._compact(now=True)
            self.gone = durable(self.gone.where(~F.col("cluster").isin(due)))

    def merge(self) -> int:
        """Fold near clusters together if their joint error allows it; returns how many were folded.

        Folded clusters leave the routing, and all members are placed in the cones of what remains.
        """
        p, self._inserted = self.params, 0
        mu = self.cells.select("index_id", "cluster", F.col("mu").alias("m"))
        error = self.members().join(mu, ["index_id", "cluster"]).withColumn("sq_dist", V.sq_l2("vec", "m"))
        cells = durable(maintain.quantization_error(error).join(self.cells.select("index_id", "cluster", "mu"), ["index_id", "cluster"]))
        plan = durable(maintain.merge_plan(maintain.merge_gain(maintain.merge_pairs(cells, p.merge_eps**2, p.d), cells, p.merge_ratio)))
        folded = [r["folded"] for r in plan.select("folded").collect()]
        if folded:
            rows = durable(self.members().select("index_id", "id", "vec"))
            self.own = {c: axes for c, axes in self.own.items() if c not in folded}
            self.drift = durable(self.drift.where(~F.col("cluster").isin(folded)))
            self.cells = durable(maintain.merged(cells, plan).select("index_id", "cluster", "mu", F.col("n").alias("stated")))
            self.segments, self.gone = [self._laid(rows, self._next())], self.spark.createDataFrame([], GONE)
            self._recount()
        return len(folded)

    # keeping

    def save(self, folder: str) -> None:
        """Write all tables, dead ids, drift and sketch included, and the parameters with the number of rows of each last: a folder without them is
        no index."""
        folder = folder.rstrip("/")
        tables = {"members": self._everything(), "cells": self.cells, "gone": self.gone, "drift": self.drift, "sketch": self.sketch()}
        for name, table in tables.items():
            table.write.parquet(f"{folder}/{name}")
        rows = {name: self.spark.read.parquet(f"{folder}/{name}").count() for name in tables}
        kept = {"params": asdict(self.params), "axes": self.axes, "own": list(self.own.items()), "rows": rows, "batch": self._batch, "inserted": self._inserted}
        if not Numbered(self.spark, f"{folder}/params").create(1, kept):
            raise FileExistsError(f"{folder} holds an index already")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, d: int | None = None, metric: str | None = None) -> FanIndex:
        """A saved index; ValueError if it is of another dimension or metric, or a table has not the rows it should have.

        Only the sketch may be missing or cut short: it can be computed again.
        """
        folder = folder.rstrip("/")
        kept = Numbered(spark, f"{folder}/params").read(1)
        params = Params(**kept["params"])
        if (d or params.d) != params.d or V.metric_name(metric or params.metric) != params.metric:
            raise ValueError(f"the index has {params.d} elements under {params.metric}")
        tables = {name: spark.read.parquet(f"{folder}/{name}") for name in ("members", "cells", "gone", "drift")}
        for name, table in tables.items():
            if (n := table.count()) != kept["rows"][name]:
                raise ValueError(f"{name} should have {kept['rows'][name]} rows and has {n}")
        own = {c: axes for c, axes in kept["own"]}
        index = cls(spark, params, [(i, a) for i, a in kept["axes"]], tables["cells"], [tables["members"]], tables["gone"], tables["drift"], own)
        index._batch, index._inserted = kept["batch"], kept["inserted"]
        return index

    @classmethod
    def stored_sketch(cls, spark: SparkSession, folder: str) -> DataFrame:
        """(id, sketch) as saved; computed again from the members if it is missing or has not the rows it should have."""
        folder = folder.rstrip("/")
        kept = Numbered(spark, f"{folder}/params").read(1)
        try:
            rows = spark.read.parquet(f"{folder}/sketch")
            if rows.count() == kept["rows"]["sketch"]:
                return rows
        except Exception:  # no folder, or files that cannot be read
            pass
        return cls.load(spark, folder).sketch()


@dataclass
class Tuned:
    """The winner of a tuning: its index, every trial (cones per vector, alpha, score), and its search settings (cp, fp, w, cands, recall)."""

    index: FanIndex
    trials: list[tuple[int, float, float]]
    alpha: float
    sweep: DataFrame


def tune(vectors: DataFrame, queries: DataFrame, d: int, k: int = 10, n_sample: int | None = None, count: int = 10, seed: int = 0) -> Tuned:
    """Choose alpha and the cones per vector for (id, vec) on a bounded sample, build the winner on everything, and sweep its search settings.

    Trials see ``tuner.sample_size`` vectors and ASKED queries (qid, q) of smallest hash, the sweep SWEPT queries against the exact answer.
    """
    spark, rows = vectors.sparkSession, durable(_rows(vectors, d, "l2"))
    n = rows.count()
    first = rows.orderBy(F.xxhash64("id"), "id").limit(tuner.sample_size(n, n_sample)).select("vec").collect()
    asked = queries.where(F.col("qid").isNotNull() & V.usable("q", d)).orderBy(F.xxhash64("qid"), "qid").limit(tuner.SWEPT).select("q").collect()
    if not n or not asked:
        raise ValueError("tuning needs usable vectors and queries")
    x, q = (np.array([r[0] for r in got], float) for got in (first, asked))
    fans, wide, window = tuner.scale_params(n, d)
    fans = min(fans, d)
    tried = tuner.trials(spark, x, q[: tuner.ASKED], fans, window, k, count, seed)
    top, alpha, _ = max(tried, key=lambda t: (t[2], -t[0], -t[1]))
    nlist = max(1, round(alpha * math.sqrt(n)))
    index = FanIndex.fit(rows.select("id", "vec"), d, nlist, min(d, tuner.viable_fans(n, nlist, wide)), top, seed=seed)
    asks = spark.createDataFrame([(0, i, [float(v) for v in r]) for i, r in enumerate(q)], "index_id int, id bigint, vec array<float>")
    grouped = lambda df: df.select(F.col("index_id").alias("grp"), "id", "vec")
    truth: dict[int, set[int]] = {}
    for r in exact.nearest(grouped(asks), grouped(rows), k, "l2", d).select("qid", "global_id").collect():  # SWEPT x k rows
        truth.setdefault(r["qid"], set()).add(r["global_id"])
    swept = tuner.sweep(index._live(), asks, index._centroids(), index._directions(), truth, index.params.fans, window, d)
    return Tuned(index, tried, alpha, swept)


class ProjectionIndex:
    """Sorted projections on random unit directions; rank windows give candidates, exact distances the answer."""

    def __init__(self, vectors: DataFrame, d: int, projections: int = 16, seed: int = 0):
        self.d, spark = d, vectors.sparkSession
        self.axes = projection.axis_table(spark, projection.random_axes(projections, d, seed))
        self.vectors = durable(_rows(vectors, d, "l2"))
        self.projected = durable(projection.projections(self.vectors, self.axes, "vec", d))

    def _asks(self, queries: DataFrame) -> DataFrame:
        return queries.where(F.col("qid").isNotNull() & V.usable("q", self.d)).select(F.lit(0).alias("index_id"), "qid", F.col("q").cast("array<float>").alias("vec"))

    def candidates(self, queries: DataFrame, window: int = 100) -> DataFrame:
        """(qid, id): within ``window`` ranks of the query on some direction."""
        asks = projection.projections(self._asks(queries), self.axes, "vec", self.d)
        return projection.candidates(projection.sorted_lists(self.projected, asks, ["index_id"]), ["index_id"], window)

    def search(self, queries: DataFrame, k: int = 10, window: int = 100) -> DataFrame:
        """(qid, rank, id, dist): the k nearest candidates with squared distances."""
        asks = projection.projections(self._asks(queries), self.axes, "vec", self.d)
        lists = projection.sorted_lists(self.projected, asks, ["index_id"], carry=True)
        found = projection.nearest_in_windows(lists, ["index_id"], window, k, self.d)
        ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("sq", "id"))).where(F.col("rank") <= k)
        return ranked.select("qid", F.col("rank").cast("int").alias("rank"), "id", F.col("sq").alias("dist"))
