"""Upkeep: live counts, running centroids, tombstones, and merging clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.functions.vecmath import sq_l2_at

#: Share of tombstones from which a cluster is compacted (fixed value of the index).
COMPACT_AT = 0.10


def vector_sums(rows: DataFrame, by: list[str], vec: str, places: int = 12) -> DataFrame:
    """(by, n, sums): element-wise sums as decimals, so the order of rows doesn't matter; a row per group.

    Partial sums per element combine before the shuffle.
    """
    parts = rows.select(*by, F.posexplode(vec).alias("pos", "x"))
    sums = parts.groupBy(*by, "pos").agg(F.sum(F.col("x").cast("double").cast(f"decimal(28,{places})")).alias("s"), F.count("*").alias("n"))
    packed = sums.groupBy(*by).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("z"))  # one entry per element
    return packed.select(*by, "n", F.col("z.s").alias("sums"))


def means(rows: DataFrame, by: list[str], vec: str) -> DataFrame:
    """(by, n, mu): centroids."""
    total = vector_sums(rows, by, vec).withColumnRenamed("n", "n_")
    return total.select(*by, F.col("n_").alias("n"), F.transform("sums", lambda s: s.cast("double") / F.col("n_")).alias("mu"))


def running_mean(base: DataFrame, batch: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, mu): means of ``base`` and ``batch`` (both by, vec) together, from their sums and counts."""
    both = vector_sums(base, by, "vec").unionByName(vector_sums(batch, by, "vec"))
    parts = both.select(*by, "n", F.posexplode("sums").alias("pos", "s")).groupBy(*by, "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    packed = parts.groupBy(*by).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("z"))
    packed = packed.withColumnRenamed("n", "n_")
    return packed.select(*by, F.col("n_").alias("n"), F.transform("z", lambda e: e["s"].cast("double") / F.col("n_")).alias("mu"))


def live_counts(assigned: DataFrame, dead: DataFrame) -> DataFrame:
    """(index_id, cluster, n, n_tomb, fraction): members and tombstones of each cluster; ``dead`` (id)."""
    marked = assigned.join(dead.select("id", F.lit(1).alias("gone")).distinct(), "id", "left")
    counts = marked.groupBy("index_id", "cluster").agg(F.count("*").alias("n"), F.count("gone").alias("n_tomb"))
    return counts.withColumn("fraction", F.col("n_tomb") / F.col("n"))


def compacted(assigned: DataFrame, dead: DataFrame, at: float = COMPACT_AT) -> DataFrame:
    """(index_id, cluster, id): the members of clusters due for compaction, without their tombstones."""
    due = live_counts(assigned, dead).where(F.col("fraction") >= at).select("index_id", "cluster")
    return assigned.join(due, ["index_id", "cluster"], "left_semi").join(dead, "id", "left_anti").select("index_id", "cluster", "id")


def quantization_error(assigned: DataFrame) -> DataFrame:
    """(index_id, cluster, n, error): mean squared distance to the centroid; ``assigned`` has sq_dist."""
    total = F.sum(F.col("sq_dist").cast("decimal(28,12)")).cast("double")
    return assigned.groupBy("index_id", "cluster").agg(F.count("*").alias("n"), (total / F.count("*")).alias("error"))


def merge_pairs(cells: DataFrame, limit_sq: float, d: int = 32) -> DataFrame:
    """(index_id, a, b, sq): pairs of filled clusters of an index nearer than the limit; ``cells`` (index_id, cluster, mu, n, error).

    An index has at most 128 clusters, so at most 8,128 pairs are looked at per index.
    """
    left = cells.where("n > 0").select("index_id", F.col("cluster").alias("a"), F.col("mu").alias("mu_a"))
    right = cells.where("n > 0").select("index_id", F.col("cluster").alias("b"), F.col("mu").alias("mu_b"))
    pairs = left.join(right, "index_id").where("a < b").withColumn("sq", sq_l2_at("mu_a", "mu_b", d))
    return pairs.where(F.col("sq") < limit_sq).select("index_id", "a", "b", "sq")


def merge_gain(pairs: DataFrame, cells: DataFrame, ratio: float = 0.5) -> DataFrame:
    """(index_id, a, b, sq, gain, passes): gain = NaNb/(Na+Nb)^2 * sq against ``ratio`` times the sum of both errors."""
    a = cells.select("index_id", F.col("cluster").alias("a"), F.col("n").cast("double").alias("na"), F.col("error").alias("ea"))
    b = cells.select("index_id", F.col("cluster").alias("b"), F.col("n").cast("double").alias("nb"), F.col("error").alias("eb"))
    both = pairs.join(a, ["index_id", "a"]).join(b, ["index_id", "b"])
    gain = F.col("na") * F.col("nb") / ((F.col("na") + F.col("nb")) * (F.col("na") + F.col("nb"))) * F.col("sq")
    rows = both.withColumn("gain", gain)
    return rows.select("index_id", "a", "b", "sq", "gain", (F.col("gain") <= ratio * (F.col("ea") + F.col("eb"))).alias("passes"))


def merge_plan(gains: DataFrame) -> DataFrame:
    """(index_id, kept, folded): passing pairs that are each other's nearest, so no cluster is in two merges."""
    ok = gains.where("passes")
    ends = ok.select("index_id", F.col("a").alias("c"), F.col("b").alias("o"), "sq").unionByName(ok.select("index_id", F.col("b").alias("c"), F.col("a").alias("o"), "sq"))
    nearest = ends.groupBy("index_id", "c").agg(F.min(F.struct("sq", "o")).alias("m")).select("index_id", "c", F.col("m.o").alias("o"))
    back = nearest.select("index_id", F.col("o").alias("c"), F.col("c").alias("o"))
    return nearest.join(back, ["index_id", "c", "o"]).where("c < o").select("index_id", F.col("c").alias("kept"), F.col("o").alias("folded"))


def merged(cells: DataFrame, plan: DataFrame) -> DataFrame:
    """(index_id, cluster, n, mu): clusters after merging, kept ones with the weighted centroid; folded ones are gone."""
    other = cells.select("index_id", F.col("cluster").alias("folded"), F.col("n").alias("n2"), F.col("mu").alias("mu2"))
    pairs = plan.join(other, ["index_id", "folded"]).select("index_id", F.col("kept").alias("cluster"), "n2", "mu2")
    left = cells.join(plan.select("index_id", F.col("folded").alias("cluster")), ["index_id", "cluster"], "left_anti").join(pairs, ["index_id", "cluster"], "left")
    # names of their own: inside a lambda a name would mean the column that the same select makes
    left = left.withColumnRenamed("n", "n1").withColumnRenamed("mu", "mu1")
    total = (F.col("n1") + F.col("n2")).cast("double")
    weighted = F.zip_with("mu1", "mu2", lambda x, y: (F.col("n1") * x + F.col("n2") * y) / total)
    mu = F.when(F.col("mu2").isNull(), F.col("mu1")).otherwise(weighted)
    return left.select("index_id", "cluster", (F.col("n1") + F.coalesce("n2", F.lit(0))).alias("n"), mu.alias("mu"))
