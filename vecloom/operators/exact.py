"""Exact nearest neighbours: every query against every vector of its group, in blocks.

The vectors of a group are cut into blocks by a hash of their id, as many as its counted size asks for; the queries of a group visit all
its blocks.  A block compares by matrix
product, keeps what can be among the k best, re-scores that element by element, and hands on k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.functions.vecmath import from_sq, metric_name
from vecloom.operators.coarse import distinct, in_order, matrix
from vecloom.sources.tables import ship_code, slices, small_enough

_PAIRS = 4_000_000
#: Vectors of a block: few enough to occupy all tasks, within these bounds.
LEAST_BLOCK, MOST_BLOCK = 4_096, 65_536
#: Bytes up to which the number of blocks per group is broadcast.
CUT_LIMIT = 4 * 2**20


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their norm (summed in order); norms below 1e-10 count as 1."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * x[:, j]
    norm = np.sqrt(total)
    return x / np.where(norm < 1e-10, 1.0, norm)[:, None]


def block_best(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(qid, id, squared distance) of each query's k best rows of one block, by (distance, id)."""
    out = []
    xx = (x * x).sum(1)
    step = max(1, _PAIRS // len(x))
    for a in range(0, len(q), step):
        part = q[a : a + step]
        dist = xx[None] + (part * part).sum(1)[:, None] - 2.0 * (part @ x.T)
        if len(x) > k:
            kth = np.partition(dist, k - 1, axis=1)[:, k - 1]
            qi, xi = np.nonzero(dist <= (kth + 1e-9 * (1.0 + np.abs(kth)))[:, None])
        else:
            qi, xi = (m.ravel() for m in np.meshgrid(np.arange(len(part)), np.arange(len(x)), indexing="ij"))
        exact = in_order(x[xi], part[qi])
        order = np.lexsort((ids[xi], exact, qi))
        qi, gid, exact = qi[order], ids[xi][order], exact[order]
        keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
        out.append((qids[a + qi[keep]], gid[keep], exact[keep]))
    return tuple(np.concatenate(c) for c in zip(*out))


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "l2", d: int = 32, blocks: int | None = None) -> DataFrame:
    """(qid, global_id, dist, rank): the k nearest rows of ``vectors`` (grp, id, vec) for each of ``queries`` (grp, id, vec).

    Only rows of the same ``grp`` are compared.  Ranked by (distance, id); fewer than k come out if the group has fewer.  Rows must
    be usable; whole rows repeated count once.  Cosine normalises both sides, a zero vector stays zero.
    """
    ship_code(vectors.sparkSession)
    kind = metric_name(metric)
    counts = vectors.groupBy(F.col("grp").cast("bigint").alias("grp")).agg(F.count("*").alias("n"))
    rows_each = F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.col("n") / (4 * slices(vectors.sparkSession)))))
    cut = counts.select("grp", (F.lit(blocks) if blocks else F.ceil(F.col("n") / rows_each)).cast("int").alias("parts"))
    if small_enough(cut, 32, CUT_LIMIT):
        cut = F.broadcast(cut)
    side = lambda df, s: df.select(F.col("grp").cast("bigint").alias("grp"), "salt", F.lit(s).alias("side"), F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<float>").alias("vec"))
    known = lambda df: df.select(F.col("grp").cast("bigint").alias("grp"), "id", "vec").join(cut, "grp")
    rows = side(known(vectors).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")), 0)
    asks = side(known(queries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), 1)
    met = rows.unionByName(asks).repartition("grp", "salt").sortWithinPartitions("grp", "salt", "side")
    schema = pa.schema([("qid", pa.int64()), ("global_id", pa.int64()), ("sq", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held, ready = None, [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            grp, salt, which, who = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            x = matrix(b.column(4), d).astype(np.float64)
            if kind == "cosine":
                x = unit(x)
            cuts = np.flatnonzero(np.r_[True, (grp[1:] != grp[:-1]) | (salt[1:] != salt[:-1])])
            out = []
            for a, z in zip(cuts.tolist(), np.r_[cuts[1:], len(grp)].tolist()):
                if (here := (int(grp[a]), int(salt[a]))) != key:
                    key, ids, held, ready = here, [], [], None
                split = a + int((which[a:z] == 0).sum())
                if split > a:
                    ids.append(who[a:split])
                    held.append(x[a:split])
                if split < z and ids:
                    if ready is None:
                        every, points = np.concatenate(ids), np.concatenate(held)
                        own = distinct(every, points)
                        ready = every[own], points[own]
                    out.append(block_best(*ready, who[split:z], x[split:z], k))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    best = met.mapInArrow(run, "qid bigint, global_id bigint, sq double")
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("sq", "global_id"))).where(F.col("rank") <= k)
    return ranked.select("qid", "global_id", from_sq("sq", metric).alias("dist"), F.col("rank").cast("int").alias("rank"))


def kth_distance(found: DataFrame, k: int) -> DataFrame:
    """(qid, kth): the distance at rank k; queries with fewer rows have none."""
    return found.where(F.col("rank") == k).select("qid", F.col("dist").alias("kth"))


def distance_stats(found: DataFrame, k: int, d: int) -> DataFrame:
    """(mean, median, p10, p90, sigma) of the k-th distances; sigma is the mean over the root of the dimension."""
    kth = kth_distance(found, k)
    cut = lambda p: F.percentile("kth", F.lit(p))
    return kth.agg(F.avg(F.col("kth").cast("decimal(28,12)")).cast("double").alias("mean"), cut(0.5).alias("median"), cut(0.1).alias("p10"), cut(0.9).alias("p90"), (F.avg(F.col("kth").cast("decimal(28,12)")).cast("double") / F.sqrt(F.lit(float(d)))).alias("sigma"))
