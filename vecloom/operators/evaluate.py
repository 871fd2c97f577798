"""Quality of results, and choosing among configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(recall): the share of the true k nearest (qid, id) that were found; 0 rows of truth give null."""
    hits = truth.join(found.select("qid", "id").distinct().withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    return hits.agg((F.count("hit") / F.greatest(F.countDistinct("qid") * k, F.lit(1))).alias("recall"))


def distance_ratio(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(ratio): mean over queries of (mean found distance) / (mean true distance + 1e-10)."""
    mean = lambda df, name: df.groupBy("qid").agg(F.avg(F.col("dist").cast("decimal(28,12)")).cast("double").alias(name))
    both = mean(found, "f").join(mean(truth, "t"), "qid")
    return both.agg(F.avg((F.col("f") / (F.col("t") + 1e-10)).cast("decimal(28,12)")).cast("double").alias("ratio"))


def quality(found: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 10, 100)) -> DataFrame:
    """(r1, r10, ..., ratio): for each k the share of the true k nearest among the first k found; and the distance ratio.

    Both have (qid, rank, id, dist); a query with fewer than k true neighbours counts what it has.
    """
    both = truth.select("qid", "id", F.col("rank").alias("true")).join(found.select("qid", "id", F.col("rank").alias("got")), ["qid", "id"], "left")
    share = lambda k: F.count_if((F.col("true") <= k) & (F.col("got") <= k)) / F.greatest(F.count_if(F.col("true") <= k), F.lit(1))
    return both.agg(*[share(k).alias(f"r{k}") for k in ks]).crossJoin(distance_ratio(found, truth))  # one row each


def mean_candidates(pairs: DataFrame) -> DataFrame:
    """(cands): candidates per query, over all queries that have any."""
    return pairs.groupBy("qid").agg(F.count("*").alias("n")).agg(F.avg("n").alias("cands"))


def pareto(sweep: DataFrame) -> DataFrame:
    """The rows of ``sweep`` (cands, recall, ...) that no cheaper row matches in recall, cheapest first.

    A sweep holds one row per configuration, so its windows are small whatever the data.
    """
    order = W.partitionBy(F.lit(0)).orderBy("cands", F.desc("recall"), *[c for c in sweep.columns if c not in ("cands", "recall")])
    before = F.max("recall").over(order.rowsBetween(W.unboundedPreceding, -1))
    return sweep.withColumn("_b", before).where("_b is null or recall > _b").drop("_b")


def knee(front: DataFrame) -> DataFrame:
    """The row of a frontier farthest from the chord between its ends, both axes scaled to 0..1; the last one of a flat or tiny front."""
    every = W.partitionBy(F.lit(0))
    x0, x1, y0, y1 = (f(c).over(every) for c in ("cands", "recall") for f in (F.min, F.max))
    x = (F.col("cands") - x0) / F.when(x1 > x0, x1 - x0).otherwise(1)
    y = (F.col("recall") - y0) / F.when(y1 > y0, y1 - y0).otherwise(1)
    flat = (F.count("*").over(every) <= 2) | (x1 == x0) | (y1 == y0)
    # the chord runs from (0, 0) to (1, 1)
    away = F.when(flat, F.lit(0.0)).otherwise(F.abs(y - x))
    placed = front.withColumn("_away", F.round(away, 12))
    last = F.row_number().over(every.orderBy(F.desc("_away"), F.desc("cands")))
    return placed.withColumn("_r", last).where("_r = 1").drop("_r", "_away")


def suggestions(sweep: DataFrame, targets: tuple[float, ...] = (0.8, 0.9, 0.95, 0.99, 1.0)) -> DataFrame:
    """(target, met, ...): the cheapest configuration reaching each recall, else the one of greatest recall."""
    both = sweep.withColumn("target", F.explode(F.array(*map(F.lit, targets)))).withColumn("met", F.col("recall") >= F.col("target"))
    price = F.when(F.col("met"), F.col("cands")).otherwise(F.lit(0))
    lack = F.when(F.col("met"), F.lit(0.0)).otherwise(-F.col("recall"))
    order = W.partitionBy("target").orderBy(F.desc("met"), price, lack, "cands", *[c for c in sweep.columns if c not in ("cands", "recall")])
    return both.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def scaling_exponent(points: DataFrame) -> DataFrame:
    """(slope, verdict) of ln y over ln x of (x, y): how a cost grows with the size; rows that are not positive are left out."""
    fit = points.where("x > 0 and y > 0").agg(F.regr_slope(F.ln("y"), F.ln("x")).alias("slope"))
    verdict = F.when(F.col("slope") < 0.15, "constant").when(F.col("slope") < 0.35, "logarithmic").when(F.col("slope") < 0.65, "root").otherwise("linear")
    return fit.select(F.round("slope", 6).alias("slope"), verdict.alias("verdict"))
