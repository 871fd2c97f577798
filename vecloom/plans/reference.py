"""Queries of the vector-search engine itself, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import vecmath as V
from vecloom.operators import coarse, cones, evaluate, exact, fold, maintain, projection, search
from vecloom.operators.positions import running
from vecloom.plans.sql import D, D_EMB, dot, query, sq, unit, usable
from vecloom.sources.tables import durable, read, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None):
    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


# shared inputs


def stored(spark: SparkSession, base: str) -> DataFrame:
    """(index_id, id, vec): usable vectors, repeated rows once."""
    return coarse.usable_vectors(read(spark, base, "vectors"), D).distinct()


def loaded(spark: SparkSession, base: str) -> DataFrame:
    """(index_id, id, vec): usable vectors as they lie; operators that bring equal ids together drop repeated rows there."""
    return coarse.usable_vectors(read(spark, base, "vectors"), D)


def asked(spark: SparkSession, base: str) -> DataFrame:
    rows = read(spark, base, "queries")
    return rows.where(F.col("qid").isNotNull() & F.col("index_id").isNotNull() & V.usable("q", D)).select("index_id", F.col("qid").alias("id"), F.col("q").alias("vec"))


def centroids(spark: SparkSession, base: str) -> DataFrame:
    return coarse.centroid_rows(read(spark, base, "checkpoints"), read(spark, base, "checkpoint_clusters"), D)


def axes(spark: SparkSession, base: str) -> list[tuple[int, list[float]]]:
    return projection.axis_rows(read(spark, base, "axes"))


def asks_q(spark: SparkSession, base: str) -> DataFrame:
    return asked(spark, base).select(F.col("id").alias("qid"), F.col("vec").alias("q"))


def bodies(spark: SparkSession, base: str) -> DataFrame:
    return stored(spark, base).select("id", "vec")


def cells(spark: SparkSession, base: str) -> coarse.Prepared:
    """The checkpoints' cells with the vectors in each counted."""
    return coarse.counted(loaded(spark, base), centroids(spark, base), D)


def laid_out(spark: SparkSession, base: str, clusters: int = 4, fans: int = 2) -> tuple[DataFrame, DataFrame]:
    """(members of the cones, visits of the queries), both by the parts of clusters."""
    known, own = cells(spark, base), projection.axis_rows(read(spark, base, "axes"))
    return cones.members(loaded(spark, base), known, own), cones.visits(asked(spark, base), known, own, clusters, fans)


def cone_rows(spark: SparkSession, base: str) -> DataFrame:
    return cones.entries(stored(spark, base), centroids(spark, base), axes(spark, base))


def homes(spark: SparkSession, base: str, carry: bool = False) -> DataFrame:
    """(index_id, id, cluster, sq_dist[, vec]) of every vector in an index with a complete checkpoint."""
    return coarse.nearest_cells(stored(spark, base), centroids(spark, base), carry=carry).where("cluster >= 0").drop("rank")


def grouped(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("index_id").alias("grp"), "id", "vec")


def embedded(spark: SparkSession, base: str) -> DataFrame:
    rows = read(spark, base, "embeddings").where(V.usable("embedding", D_EMB) & F.col("vec_id").isNotNull())
    return rows.select(F.lit(0).alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


# scans and vector arithmetic


@register(f"""SELECT index_id, count(*) AS n_rows, count_if(vector IS NULL)::BIGINT AS n_null, count_if(vector IS NOT NULL AND len(vector) <> 32)::BIGINT AS n_length,
  count_if(vector IS NOT NULL AND len(vector) = 32 AND NOT {usable("vector")})::BIGINT AS n_nan, count_if({usable("vector")})::BIGINT AS n_usable,
  count_if({usable("vector")} AND len(list_filter(vector, lambda x: x <> 0)) = 0)::BIGINT AS n_zero FROM vectors GROUP BY index_id""")
def scan_validate_vectors(spark, base):
    good, long = V.usable("vector", D), F.coalesce(F.size("vector") != D, F.lit(False))
    there = F.col("vector").isNotNull()
    zero = good & F.forall("vector", lambda x: x == 0)
    return read(spark, base, "vectors").groupBy("index_id").agg(
        F.count("*").alias("n_rows"), F.count_if(~there).alias("n_null"), F.count_if(there & long).alias("n_length"), F.count_if(there & ~long & ~good).alias("n_nan"),
        F.count_if(good).alias("n_usable"), F.count_if(F.coalesce(zero, F.lit(False))).alias("n_zero"),
    )


@register(query("SELECT index_id, ((row_number() OVER (PARTITION BY index_id ORDER BY global_id) - 1) // 4096)::BIGINT AS chunk, global_id FROM stored", "stored").replace("SELECT index_id, ((row", "SELECT index_id, chunk, count(*) AS n, min(global_id) AS first_id, max(global_id) AS last_id FROM (SELECT index_id, ((row") + ") GROUP BY ALL")
def chunk_bounds(spark, base):
    """The sequential chunks of 4,096 rows a builder reads, by id."""
    placed = running(stored(spark, base).select("index_id", "id", F.lit(1).alias("one")), ["index_id"], "id", [], "one", "place")
    return placed.groupBy("index_id", F.floor(F.col("place") / 4096).alias("chunk")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@register(query(f"SELECT global_id, {dot('v', 'v')} AS norm_sq, sqrt({dot('v', 'v')}) AS norm FROM stored", "stored"))
def vector_norms(spark, base):
    return stored(spark, base).select(F.col("id").alias("global_id"), V.sq_norm("vec").alias("norm_sq"), V.norm("vec").alias("norm"))


@register(query(f"SELECT global_id, {unit('v')} AS unit FROM stored", "stored"))
def normalize_vectors(spark, base):
    return stored(spark, base).select(F.col("id").alias("global_id"), V.normalise("vec").alias("unit"))


@register(query(f"SELECT qid, index_id, {unit('v')} AS q_unit FROM asked", "asked"))
def prepared_queries(spark, base):
    return asked(spark, base).select(F.col("id").alias("qid"), "index_id", V.normalise("vec").alias("q_unit"))


def _nearest_members(spark, base):
    """(qid, id) of the members of each query's nearest filled cluster."""
    route = coarse.nearest_cells(asked(spark, base), centroids(spark, base), filled_only=True).where("cluster >= 0").select(F.col("id").alias("qid"), "index_id", "cluster")
    return route.join(homes(spark, base).select("index_id", "cluster", "id"), ["index_id", "cluster"]).select("qid", "id")


@register(query(f"""SELECT r.qid, h.global_id, {sq("r.v", "h.v")} AS sq_dist, sqrt({sq("r.v", "h.v")}) AS l2_dist, {sq("r.v", "h.v")} * 0.5 AS half_dist
FROM routed r JOIN home h USING (index_id, cluster) WHERE r.cluster_rank = 1""", "routed", "home"))
def candidate_distances(spark, base):
    """Exact distances of given candidates, in the forms each metric returns."""
    scored = search.with_distance(_nearest_members(spark, base), asks_q(spark, base), bodies(spark, base))
    return scored.select("qid", F.col("id").alias("global_id"), V.from_sq("sq", "sqeuclidean").alias("sq_dist"), V.from_sq("sq", "l2").alias("l2_dist"), V.from_sq("sq", "cosine").alias("half_dist"))


# exact search


def _knn(spark, base, metric, k=10):
    return exact.nearest(grouped(asked(spark, base)), grouped(loaded(spark, base)), k, metric, D)


@register(query("SELECT qid, rank, global_id, dist FROM truth", "truth"))
def exact_knn_l2(spark, base):
    return _knn(spark, base, "l2")


@register(query("SELECT qid, rank, global_id, dist * dist AS dist FROM truth", "truth").replace("sqrt(d) AS dist", "d AS dist").replace("dist * dist AS dist", "dist"))
def exact_knn_sqeuclidean(spark, base):
    return _knn(spark, base, "sqeuclidean")


@register(f"""WITH u AS MATERIALIZED (SELECT vec_id, {unit("embedding", D_EMB)} AS v FROM embeddings)
SELECT qid, rank::INTEGER AS rank, global_id, d * 0.5 AS dist FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, global_id) AS rank FROM (
    SELECT a.vec_id AS qid, b.vec_id AS global_id, {sq("a.v", "b.v", D_EMB)} AS d FROM u a CROSS JOIN u b)) WHERE rank <= 10""")
def exact_knn_cosine(spark, base):
    rows = embedded(spark, base)
    return exact.nearest(rows, rows, 10, "cosine", D_EMB)


@register(query(f"""SELECT qid, rank::INTEGER AS rank, axis::BIGINT AS global_id, sqrt(d) AS dist FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, axis) AS rank FROM (SELECT qid, axis, {sq("v", "(a::FLOAT[])")} AS d FROM asked CROSS JOIN ax))""", "asked", "ax"))
def exact_knn_k_exceeds_n(spark, base):
    """Ten neighbours asked for among four vectors: four come out."""
    few = read(spark, base, "axes").select(F.lit(0).alias("grp"), F.col("axis").cast("bigint").alias("id"), F.col("a").alias("vec"))
    return exact.nearest(asked(spark, base).select(F.lit(0).alias("grp"), "id", "vec"), few, 10, "l2", D)


@register(f"""WITH u AS MATERIALIZED (SELECT vec_id, {unit("embedding", D_EMB)} AS v FROM embeddings)
SELECT 0::BIGINT AS qid, rank::INTEGER AS rank, global_id, d * 0.5 AS dist FROM (
  SELECT vec_id AS global_id, {dot("v", "v", D_EMB)} AS d, row_number() OVER (ORDER BY {dot("v", "v", D_EMB)}, vec_id) AS rank FROM u) WHERE rank <= 10""")
def exact_knn_zero_query(spark, base):
    """A zero query under cosine stays zero, at half from every vector."""
    zero = spark.createDataFrame([(0, 0, [0.0] * D_EMB)], "grp int, id bigint, vec array<float>")
    return exact.nearest(zero, embedded(spark, base), 10, "cosine", D_EMB)


@register(query("SELECT qid, dist AS kth FROM truth WHERE rank = 10", "truth"))
def kth_distance(spark, base):
    return exact.kth_distance(_knn(spark, base, "l2"), 10)


@register(query("""SELECT (sum(dist::DECIMAL(28,12)) / count(*))::DOUBLE AS mean, quantile_cont(dist, 0.5) AS median, quantile_cont(dist, 0.1) AS p10, quantile_cont(dist, 0.9) AS p90,
  (sum(dist::DECIMAL(28,12)) / count(*))::DOUBLE / sqrt(32.0::DOUBLE) AS sigma FROM truth WHERE rank = 10""", "truth"))
def nn_distance_stats(spark, base):
    return exact.distance_stats(_knn(spark, base, "l2"), 10, D)


# projections


def _point_projections(spark, base):
    return projection.projections(stored(spark, base), read(spark, base, "axes"), "vec", D)


def _query_projections(spark, base):
    return projection.projections(asked(spark, base).withColumnRenamed("id", "qid"), read(spark, base, "axes"), "vec", D)


@register(query("SELECT global_id, axis, p FROM pall", "pall"))
def project_axes(spark, base):
    return projection.by_axis(_point_projections(spark, base), F.col("id").alias("global_id"))


@register(query("SELECT global_id, list(p ORDER BY axis) AS sketch FROM pall GROUP BY global_id", "pall"))
def sketch_table(spark, base):
    return _point_projections(spark, base).select(F.col("id").alias("global_id"), F.col("proj").alias("sketch"))


@register(query("SELECT qid, axis, p, pos FROM qpos", "qpos"))
def axis_rank_positions(spark, base):
    lists = projection.sorted_lists(_point_projections(spark, base), _query_projections(spark, base), ["index_id"])
    return lists.where("is_point = 0").select(F.col("who").alias("qid"), "axis", "p", F.col("pos").cast("bigint").alias("pos"))


def _lists(spark, base, carry=False):
    return projection.sorted_lists(durable(_point_projections(spark, base)), _query_projections(spark, base), ["index_id"], carry)


@register(query("SELECT axis, count(*) AS n FROM (SELECT q.qid, q.axis, p.global_id FROM qpos q JOIN ppos p ON p.index_id = q.index_id AND p.axis = q.axis AND p.pos >= q.pos - 100 AND p.pos < q.pos + 100) GROUP BY axis", "qpos", "ppos"))
def window_candidates(spark, base):
    """Members of the rank windows, counted per axis."""
    return projection.window_counts(_lists(spark, base), ["index_id"], 100)


@register(query("SELECT qid, global_id FROM wcands", "wcands"))
def projection_candidates(spark, base):
    return projection.candidates(_lists(spark, base), ["index_id"], 100).select("qid", F.col("id").alias("global_id"))


def _projection_found(spark, base):
    return search.best(projection.nearest_in_windows(_lists(spark, base, carry=True), ["index_id"], 100, 10, D), 10)


@register(query("SELECT qid, rank, global_id, dist FROM wfound", "wfound"))
def projection_search(spark, base):
    return _projection_found(spark, base).withColumnRenamed("id", "global_id")


# the projection index at its own number of directions; the queries above take the few of the table axes

#: Random directions (fixed value of the index), and the window: this share of an index, at least so many ranks.
DIRECTIONS, SHARE, LEAST_WINDOW = 16, 0.02, 100


def _direction_lists(spark, base, carry=False):
    own = projection.axis_table(spark, projection.random_axes(DIRECTIONS, D))
    asks = projection.projections(asked(spark, base).withColumnRenamed("id", "qid"), own, "vec", D)
    lists = projection.sorted_lists(durable(projection.projections(stored(spark, base), own, "vec", D)), asks, ["index_id"], carry)
    return projection.scaled(lists, ["index_id"], SHARE, LEAST_WINDOW)


def _directions_found(spark, base):
    return search.best(projection.nearest_in_windows(_direction_lists(spark, base, carry=True), ["index_id"], "w", 10, D), 10)


@register()
def projection_index_candidates(spark, base):
    own, asks = projection.axis_table(spark, projection.random_axes(DIRECTIONS, D)), asked(spark, base).withColumnRenamed("id", "qid")
    return projection.scaled_candidates(loaded(spark, base), asks, own, ["index_id"], SHARE, LEAST_WINDOW, D, name="global_id")


@register()
def projection_index_search(spark, base):
    """A window that grows with the index, as a fixed one covers less and less of it."""
    return _directions_found(spark, base).withColumnRenamed("id", "global_id")


@register()
def projection_index_recall(spark, base):
    return evaluate.recall(_directions_found(spark, base), _truth(spark, base), 10)


@register()
def projection_index_ratio(spark, base):
    return evaluate.distance_ratio(_directions_found(spark, base), _truth(spark, base))


# clusters


@register(f"""SELECT label, max(n) AS n, list(m ORDER BY pos) AS mu FROM (
  SELECT label, pos, sum(x::DOUBLE::DECIMAL(28,12))::DOUBLE / count(*) AS m, count(*) AS n FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, {D_EMB + 1})) AS pos FROM embeddings) GROUP BY ALL) GROUP BY label""")
def label_centroids(spark, base):
    return maintain.means(read(spark, base, "embeddings"), ["label"], "embedding")


@register(query("SELECT global_id, cluster, sq AS sq_dist FROM home", "home"))
def assign_nearest(spark, base):
    return homes(spark, base).select(F.col("id").alias("global_id"), "cluster", "sq_dist")


@register(query("SELECT global_id, cluster, rank FROM home3", "home3"))
def assign_top_k(spark, base):
    top = coarse.nearest_cells(stored(spark, base), centroids(spark, base), top=3).where("cluster >= 0")
    return top.select(F.col("id").alias("global_id"), "cluster", "rank")


@register(query("SELECT index_id, cluster, count(*) AS n FROM home GROUP BY ALL", "home"))
def cluster_sizes(spark, base):
    return homes(spark, base).groupBy("index_id", "cluster").agg(F.count("*").alias("n"))


@register(query("SELECT index_id, cluster, n, error FROM qerr", "qerr"))
def quantization_error(spark, base):
    return maintain.quantization_error(homes(spark, base))


def _homed_vectors(spark, base):
    return homes(spark, base, carry=True)


@register(query("SELECT index_id, cluster, n, mu FROM vmean", "vmean"))
def kmeans_lloyd_step(spark, base):
    """One Lloyd round from the checkpoint's centroids: assign, then exact means."""
    return maintain.means(_homed_vectors(spark, base), ["index_id", "cluster"], "vec")


@register()
def kmeans_mllib(spark, base):
    """k-means on normalised embeddings by the library's own implementation."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = read(spark, base, "embeddings").select("vec_id", array_to_vector(V.normalise("embedding")).alias("features"))
    model = KMeans(k=16, maxIter=20, seed=0, initMode="random", distanceMeasure="cosine").fit(rows)
    return model.transform(rows).groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("n"))


@register(query("SELECT qid, cluster, cluster_rank, sq AS sq_dist FROM routed", "routed"))
def route_clusters(spark, base):
    near = coarse.nearest_cells(asked(spark, base), centroids(spark, base), top=4, filled_only=True).where("cluster >= 0")
    return near.select(F.col("id").alias("qid"), "cluster", F.col("rank").alias("cluster_rank"), "sq_dist")


# cones


@register(query("SELECT qid, cluster, cluster_rank, fan, fan_rank, score FROM visited", "visited"))
def route_cones(spark, base):
    rows = cones.probes(asked(spark, base), centroids(spark, base), axes(spark, base), 4, 2)
    return rows.where("cluster >= 0").select("qid", "cluster", "cluster_rank", "fan", "fan_rank", "score")


@register(query("SELECT cluster, fan, global_id, score, proj FROM cones", "cones"))
def cone_membership(spark, base):
    return cone_rows(spark, base).where("cluster >= 0").select("cluster", "fan", F.col("id").alias("global_id"), "score", "proj")


@register(query("SELECT index_id, cluster, fan, n FROM csize", "csize"))
def cone_sizes(spark, base):
    return cones.sizes(cone_rows(spark, base).where("cluster >= 0"))


@register(query("SELECT qid, global_id FROM ccands", "ccands"))
def cone_candidates(spark, base):
    return search.candidates(*laid_out(spark, base), 50).select("qid", F.col("id").alias("global_id"))


@register(query("SELECT DISTINCT r.qid, h.global_id FROM routed r JOIN home h USING (index_id, cluster)", "routed", "home"))
def full_cluster_bypass(spark, base):
    """Visiting all cones of a cluster is visiting its members."""
    return search.candidates(*laid_out(spark, base), 0, whole=True).select("qid", F.col("id").alias("global_id"))


@register(query("SELECT index_id, cluster, fan, list(global_id ORDER BY global_id) AS ids FROM members JOIN csize USING (index_id, cluster, fan) WHERE n <= 100 GROUP BY ALL", "members", "csize"))
def small_cone_all_ids(spark, base):
    """Cones no larger than both sides of a window are taken whole; at most 100 ids each."""
    rows = cone_rows(spark, base).where("cluster >= 0")
    small = cones.sizes(rows).where("n <= 100").select("index_id", "cluster", "fan")
    return rows.join(small, ["index_id", "cluster", "fan"], "left_semi").groupBy("index_id", "cluster", "fan").agg(F.sort_array(F.collect_list("id")).alias("ids"))


_LEVELS = search.window_levels(10, 50)
_STOP = f"""
levels AS (SELECT unnest([{", ".join(map(str, _LEVELS))}]) AS w),
lev AS MATERIALIZED (SELECT qid, global_id, min({" ".join(f"CASE WHEN rank <= {w} OR n <= {2 * w} THEN {w} ELSE" for w in _LEVELS)} NULL {"END " * len(_LEVELS)}) AS level FROM cranks GROUP BY ALL HAVING level IS NOT NULL),
scored AS MATERIALIZED (SELECT l.qid, l.global_id, l.level, {sq("q.v", "s.v")} AS d FROM lev l JOIN asked q USING (qid) JOIN stored s ON s.global_id = l.global_id),
kth AS (SELECT qid, w, sqrt(d) AS kth FROM (SELECT qid, w, d, row_number() OVER (PARTITION BY qid, w ORDER BY d) AS r FROM scored JOIN levels ON level <= w) WHERE r = 10),
gaps AS (SELECT qid, cluster, fan, w, max(g) AS gap, count(*) AS bounded FROM (SELECT qid, cluster, fan, axis, w, min(gap) AS g FROM cranks JOIN levels ON rank = w + 1 GROUP BY ALL) GROUP BY ALL),
states AS (SELECT v.qid, w, coalesce(n <= 2 * w OR coalesce(bounded, 0) < 4 OR gap >= kth, false) AS covered, kth FROM visited v JOIN csize USING (index_id, cluster, fan) CROSS JOIN levels LEFT JOIN gaps USING (qid, cluster, fan, w) LEFT JOIN kth USING (qid, w)),
per AS (SELECT qid, w, bool_and(covered) AS covered, max(kth) AS kth FROM states GROUP BY ALL),
stop AS MATERIALIZED (SELECT qid, min(w) AS w, arg_min(covered AND kth IS NOT NULL, w) AS certified FROM per WHERE kth IS NULL OR covered OR w >= {_LEVELS[-1]} GROUP BY qid)
"""


def _with_stop(final: str) -> str:
    return query("@@", "cranks", "visited", "csize", "asked", "stored").replace("\n@@", "," + _STOP + final)


def _found(rows):
    return rows.select("qid", "rank", F.col("id").alias("global_id"), F.sqrt("sq").alias("dist"))


def _stops(rows):
    return rows.where("rank = 1").select("qid", "w", "certified")


@register(_with_stop("SELECT qid, w, certified FROM stop"))
def adaptive_stop_level(spark, base):
    """The window each query stops at, and whether all its visited cones were covered (the coverage test)."""
    return _stops(search.adaptive(*laid_out(spark, base), 10, 50))


@register(_with_stop("""SELECT qid, rank::INTEGER AS rank, global_id, sqrt(d) AS dist, w, certified FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, global_id) AS rank FROM scored JOIN stop USING (qid) WHERE level <= w) WHERE rank <= 10"""))
def adaptive_search(spark, base):
    return search.adaptive(*laid_out(spark, base), 10, 50).select("qid", "rank", F.col("id").alias("global_id"), F.sqrt("sq").alias("dist"), "w", "certified")


def _orthonormal(spark, base):
    return projection.axis_table(spark, projection.random_axes(4, D, seed=0, orthonormal=True))


_SKETCH = projection.random_axes(4, D, seed=0, orthonormal=True)


@register(query(f"""SELECT qid, rank::INTEGER AS rank, global_id, sqrt(d) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, global_id) AS rank FROM (
  SELECT c.qid, c.global_id, {sq("q.v", "s.v")} AS d FROM ccands c JOIN asked q USING (qid) JOIN stored s ON s.global_id = c.global_id)) WHERE rank <= 10""", "ccands", "asked", "stored"))
def sketch_refine_search(spark, base):
    """Refinement through the sketch's lower bound gives exactly what refining every candidate gives."""
    return _found(search.adaptive(*laid_out(spark, base), 10, 50, sketch=_SKETCH))


# the same searches at the index's own defaults; the ones above are their cheaper setting, 4 clusters and window 50

#: Clusters and fans visited, windows of a search and of candidates (fixed values of the index).
CLUSTERS, FANS, WINDOW, CANDIDATE_WINDOW = 10, 2, 200, 50


def _default(spark, base):
    return laid_out(spark, base, CLUSTERS, FANS)


@register()
def cone_search_candidates(spark, base):
    return search.candidates(*_default(spark, base), CANDIDATE_WINDOW).select("qid", F.col("id").alias("global_id"))


@register()
def cone_search_cost(spark, base):
    return search.candidate_counts(*_default(spark, base), CANDIDATE_WINDOW).agg(F.avg("n").alias("cands"))


@register()
def cone_search_stop_level(spark, base):
    return _stops(search.adaptive(*_default(spark, base), 10, WINDOW))


@register()
def cone_search(spark, base):
    return search.adaptive(*_default(spark, base), 10, WINDOW).select("qid", "rank", F.col("id").alias("global_id"), F.sqrt("sq").alias("dist"), "w", "certified")


@register()
def cone_search_recall(spark, base):
    return evaluate.recall(search.adaptive(*_default(spark, base), 10, WINDOW), _truth(spark, base), 10)


@register()
def cone_search_refined(spark, base):
    """Candidates of the search's window, refined through the sketch's lower bound."""
    return _found(search.adaptive(*_default(spark, base), 10, WINDOW, sketch=_SKETCH))


_SKETCH_AXES = ", ".join("[" + ", ".join(repr(float(v)) for v in a) + "]" for a in _SKETCH)


@register(query(f"""SELECT count(*) AS pairs, count_if(low > sq + 1e-9) AS violations, round(max(low / greatest(sq, 1e-9)), 6) AS closest FROM (
  SELECT qid, global_id, any_value({sq("r.v", "h.v")}) AS sq, sum(({dot("r.v", "o.a")} - {dot("h.v", "o.a")}) * ({dot("r.v", "o.a")} - {dot("h.v", "o.a")})) AS low
  FROM routed r JOIN home h USING (index_id, cluster) CROSS JOIN (SELECT unnest([{_SKETCH_AXES}]) AS a) o WHERE r.cluster_rank = 1 GROUP BY ALL)""", "routed", "home"))
def sketch_lower_bound_check(spark, base):
    """On orthonormal axes the sketch distance never exceeds the true one."""
    own = _orthonormal(spark, base)
    asks = projection.projections(asks_q(spark, base), own, "q", D, "q_sketch")
    rows = projection.projections(bodies(spark, base), own, "vec", D, "sketch")
    both = _nearest_members(spark, base).join(asks, "qid").join(rows, "id")
    low, true = V.sq_l2("q_sketch", "sketch"), V.sq_l2("q", "vec")
    closest = F.round(F.max(low / F.greatest(true, F.lit(1e-9))), 6)
    return both.agg(F.count("*").alias("pairs"), F.count_if(low > true + 1e-9).alias("violations"), closest.alias("closest"))


_FILL = query("""SELECT qid, rank, global_id, fill FROM (
  SELECT qid, rank, global_id, false AS fill FROM short_
  UNION ALL
  SELECT qid, (have + r)::INTEGER, global_id, true FROM (
    SELECT k.qid, k.have, h.global_id, row_number() OVER (PARTITION BY k.qid ORDER BY h.global_id) AS r
    FROM lacking k JOIN heads h USING (index_id) WHERE NOT EXISTS (SELECT 1 FROM short_ x WHERE x.qid = k.qid AND x.global_id = h.global_id)) WHERE have + r <= 10)""", "asked", "stored", "routed", "home", "ax")


@register(_FILL.replace("\nSELECT qid, rank, global_id, fill FROM (", f""",
short_ AS MATERIALIZED (SELECT qid, rank::INTEGER AS rank, global_id FROM (SELECT r.qid, h.global_id, row_number() OVER (PARTITION BY r.qid ORDER BY {sq("r.v", "h.v")}, h.global_id) AS rank FROM routed r JOIN home h USING (index_id, cluster) WHERE r.cluster_rank = 1) WHERE rank <= 10),
lacking AS (SELECT q.qid, q.index_id, count(x.global_id) AS have FROM asked q LEFT JOIN short_ x USING (qid) GROUP BY ALL HAVING have < 10),
heads AS (SELECT * FROM (SELECT index_id, global_id, row_number() OVER (PARTITION BY index_id ORDER BY global_id) AS r FROM stored) WHERE r <= 20)
SELECT qid, rank, global_id, fill FROM (""", 1))
def short_result_fill(spark, base):
    """Queries whose one visited cluster holds fewer than ten are completed with the first live ids; found ones stay."""
    scored = search.with_distance(_nearest_members(spark, base), asks_q(spark, base), bodies(spark, base))
    found = search.best(scored, 10).select("qid", "rank", "id")
    asks = asked(spark, base).select(F.col("id").alias("qid"), "index_id")
    return search.filled(found, asks, stored(spark, base), 10).withColumnRenamed("id", "global_id")


# evaluation


def _truth(spark, base):
    return _knn(spark, base, "l2").select("qid", F.col("global_id").alias("id"), "dist")


@register(query("SELECT count(w.global_id) / (count(DISTINCT t.qid) * 10)::DOUBLE AS recall FROM truth t LEFT JOIN wfound w ON w.qid = t.qid AND w.global_id = t.global_id", "truth", "wfound"))
def recall_at_k(spark, base):
    return evaluate.recall(_projection_found(spark, base), _truth(spark, base), 10)


@register(query("""SELECT (sum(r::DECIMAL(28,12)) / count(*))::DOUBLE AS ratio FROM (SELECT f / (t + 1e-10::DOUBLE) AS r FROM
  (SELECT qid, (sum(dist::DECIMAL(28,12)) / count(*))::DOUBLE AS f FROM wfound GROUP BY qid) JOIN (SELECT qid, (sum(dist::DECIMAL(28,12)) / count(*))::DOUBLE AS t FROM truth GROUP BY qid) USING (qid))""", "truth", "wfound"))
def distance_ratio(spark, base):
    return evaluate.distance_ratio(_projection_found(spark, base), _truth(spark, base))


@register(query("SELECT avg(n) AS cands FROM (SELECT qid, count(*) AS n FROM ccands GROUP BY qid)", "ccands"))
def avg_candidates(spark, base):
    return search.candidate_counts(*laid_out(spark, base), 50).agg(F.avg("n").alias("cands"))


_SWEEP = """sweep AS MATERIALIZED (SELECT cp, avg(n) AS cands, (sum(hit) / (count(*) * 10))::DOUBLE AS recall FROM (
  SELECT q.qid, p.cp, (SELECT count(*) FROM rhome h WHERE h.qid = q.qid AND h.cluster_rank <= p.cp) AS n,
    (SELECT count(*) FROM rhome h JOIN truth t ON t.qid = h.qid AND t.global_id = h.global_id WHERE h.qid = q.qid AND h.cluster_rank <= p.cp) AS hit
  FROM asked q CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS cp) p) GROUP BY cp)"""
_RHOME = "rhome AS MATERIALIZED (SELECT r.qid, r.cluster_rank, h.global_id FROM routed r JOIN home h USING (index_id, cluster))"


def _sweep_sql(final: str) -> str:
    return query("@@", "routed", "home", "truth", "asked").replace("\n@@", f",\n{_RHOME},\n{_SWEEP}\n{final}")


def sweep(spark, base):
    """(cp, cands, recall): mean candidates and recall of scanning the cp nearest clusters, for cp 1 to 4."""
    near = coarse.nearest_cells(asked(spark, base), centroids(spark, base), top=4, filled_only=True).where("cluster >= 0")
    near = near.select(F.col("id").alias("qid"), "index_id", "cluster", F.col("rank").alias("cluster_rank"))
    pairs = near.join(homes(spark, base).select("index_id", "cluster", "id"), ["index_id", "cluster"])
    hits = pairs.join(_truth(spark, base).select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    per = hits.groupBy("cluster_rank").agg(F.count("*").alias("n"), F.count("hit").alias("hit"))
    total = max(1, asked(spark, base).count())
    steps = per.withColumn("cp", F.explode(F.sequence(F.col("cluster_rank"), F.lit(4))))
    return steps.groupBy("cp").agg((F.sum("n") / F.lit(total)).alias("cands"), (F.sum("hit") / F.lit(total * 10)).alias("recall"))


@register(_sweep_sql("SELECT cp, cands, recall FROM (SELECT *, max(recall) OVER (ORDER BY cands, recall DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM sweep) WHERE b IS NULL OR recall > b"))
def pareto_frontier(spark, base):
    return evaluate.pareto(sweep(spark, base))


@register(_sweep_sql("""SELECT cp, cands, recall FROM (SELECT *, row_number() OVER (ORDER BY away DESC, cands DESC) AS r FROM (
  SELECT *, CASE WHEN count(*) OVER () <= 2 OR max(cands) OVER () = min(cands) OVER () OR max(recall) OVER () = min(recall) OVER () THEN 0
    ELSE round(abs((recall - min(recall) OVER ()) / (max(recall) OVER () - min(recall) OVER ()) - (cands - min(cands) OVER ()) / (max(cands) OVER () - min(cands) OVER ())), 12) END AS away
  FROM (SELECT *, max(recall) OVER (ORDER BY cands, recall DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM sweep) WHERE b IS NULL OR recall > b)) WHERE r = 1"""))
def pareto_knee(spark, base):
    return evaluate.knee(evaluate.pareto(sweep(spark, base)))


@register(_sweep_sql("""SELECT target, met, cp, cands, recall FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY met DESC, CASE WHEN met THEN cands ELSE 0 END, CASE WHEN met THEN 0 ELSE -recall END, cands, cp) AS r FROM (
  SELECT target, recall >= target AS met, cp, cands, recall FROM sweep CROSS JOIN (SELECT unnest([0.8, 0.9, 0.95, 0.99, 1.0])::DOUBLE AS target))) WHERE r = 1"""))
def target_recall_suggestions(spark, base):
    return evaluate.suggestions(sweep(spark, base))


@register(query("""SELECT round(regr_slope(ln(y), ln(x)), 6) AS slope, CASE WHEN regr_slope(ln(y), ln(x)) < 0.15 THEN 'constant' WHEN regr_slope(ln(y), ln(x)) < 0.35 THEN 'logarithmic' WHEN regr_slope(ln(y), ln(x)) < 0.65 THEN 'root' ELSE 'linear' END AS verdict
FROM (SELECT stated::DOUBLE AS x, count(h.global_id)::DOUBLE AS y FROM cents c JOIN home h USING (index_id, cluster) WHERE stated > 0 GROUP BY index_id, cluster, stated)""", "cents", "home"))
def scaling_exponent(spark, base):
    """How live cluster sizes scale with the sizes the checkpoint states."""
    live = homes(spark, base).groupBy("index_id", "cluster").agg(F.count("*").cast("double").alias("y"))
    pairs = centroids(spark, base).join(live, ["index_id", "cluster"]).select(F.col("stated").cast("double").alias("x"), "y")
    return evaluate.scaling_exponent(pairs)


@register(query("""SELECT (SELECT count(*) FROM wfound) AS found, (SELECT count(*) FROM wfound JOIN wcands USING (qid, global_id)) AS among, (SELECT count(*) FROM truth) AS truth,
  (SELECT count(*) FROM truth JOIN wcands USING (qid, global_id)) AS held""", "wfound", "wcands", "truth"))
def candidates_superset_check(spark, base):
    """Results and how many of them are candidates (all); true neighbours and how many of them are candidates."""
    pairs = projection.candidates(_lists(spark, base), ["index_id"], 100)
    counted = lambda df, whole, part: df.select("qid", "id").join(pairs.withColumn("hit", F.lit(1)), ["qid", "id"], "left").agg(F.count("*").alias(whole), F.count("hit").alias(part))
    return counted(_projection_found(spark, base), "found", "among").crossJoin(counted(_truth(spark, base), "truth", "held"))


@register()
def search_quality(spark, base):
    """Recall at 1, 10 and 100 and the distance ratio of every search at its index's defaults, 100 neighbours asked for."""
    k = 100
    truth = durable(_knn(spark, base, "l2", k).select("qid", "rank", F.col("global_id").alias("id"), "dist"))
    ranked = lambda df: df.select("qid", "rank", "id", F.sqrt("sq").alias("dist"))
    found = {
        "cones": ranked(search.adaptive(*_default(spark, base), k, WINDOW)),
        "cones, sketch": ranked(search.adaptive(*_default(spark, base), k, WINDOW, sketch=_SKETCH)),
        "projections": search.best(projection.nearest_in_windows(_direction_lists(spark, base, carry=True), ["index_id"], "w", k, D), k),
    }
    rows = None
    for name, df in found.items():
        one = evaluate.quality(df, truth).withColumn("method", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows.select("method", "r1", "r10", "r100", "ratio")


@register(query("""SELECT index_id, n, fans, least(128, 2 * fans) AS wide, greatest(15, floor(15 * sqrt(n / 10000.0))::INTEGER) AS base_window FROM (
  SELECT index_id, count(*) AS n, least(64, greatest(16, round_even(4 * greatest(1.0, log2(count(*) / 5000.0)) / 8, 0)::INTEGER * 8)) AS fans FROM stored GROUP BY index_id)""", "stored"))
def scale_params(spark, base):
    """Fans and window by the size of each index, as columns."""
    n = F.col("n")
    fans = F.least(F.lit(64), F.greatest(F.lit(16), (F.bround(D / 8 * F.greatest(F.lit(1.0), F.log2(n / 5000)) / 8, 0) * 8).cast("int")))
    rows = stored(spark, base).groupBy("index_id").agg(F.count("*").alias("n")).withColumn("fans", fans)
    return rows.select("index_id", "n", "fans", F.least(F.lit(128), 2 * F.col("fans")).alias("wide"), F.greatest(F.lit(15), F.floor(15 * F.sqrt(n / 10_000)).cast("int")).alias("base_window"))


@register(query("""SELECT index_id, n, nlist, CASE WHEN n // (nlist * 64) >= 5 THEN 64 WHEN n // (nlist * 32) >= 5 THEN 32 ELSE 16 END AS fans FROM (
  SELECT index_id, count(*) AS n, greatest(16, floor(sqrt(count(*)))::INTEGER) AS nlist FROM stored GROUP BY index_id)""", "stored"))
def viable_fans(spark, base):
    n, nlist = F.col("n"), F.col("nlist")
    rows = stored(spark, base).groupBy("index_id").agg(F.count("*").alias("n")).withColumn("nlist", F.greatest(F.lit(16), F.floor(F.sqrt(n)).cast("int")))
    fans = F.when(F.floor(n / (nlist * 64)) >= 5, 64).when(F.floor(n / (nlist * 32)) >= 5, 32).otherwise(16)
    return rows.select("index_id", "n", "nlist", fans.alias("fans"))


# mutations


def _folded(spark, base):
    return fold.apply_feed(read(spark, base, "vectors"), read(spark, base, "mutations"))


@register(query("SELECT global_id, v AS vector FROM live", "live"))
def live_view_from_log(spark, base):
    return fold.current(_folded(spark, base))


@register(query("SELECT global_id, seq FROM ends WHERE kind = 'insert'", "ends"))
def add_visible(spark, base):
    """Ids that an insert made visible last."""
    return _folded(spark, base).where("kind = 'insert'").select("global_id", "seq")


@register(query("SELECT count(*) AS tombstones, count(l.global_id) AS leaked FROM dead d LEFT JOIN live l USING (global_id)", "dead", "live"))
def delete_excluded(spark, base):
    """Deleted ids, and how many of them are in the live view."""
    folded = _folded(spark, base)
    dead = folded.where("kind = 'delete'").select("global_id")
    return dead.join(fold.current(folded).select("global_id", F.lit(1).alias("hit")), "global_id", "left").agg(F.count("*").alias("tombstones"), F.count("hit").alias("leaked"))


@register(query("SELECT global_id, count(*) AS deletes FROM effective WHERE kind = 'delete' GROUP BY global_id HAVING count(*) > 1", "effective"))
def double_delete_noop(spark, base):
    """Ids deleted more than once: each still ends as at most one tombstone."""
    rows = fold.states_of_changes(read(spark, base, "mutations")).where("state.kind = 'delete'")
    return rows.groupBy("global_id").agg(F.count("*").alias("deletes")).where("deletes > 1")


@register(query("SELECT e.global_id, e.seq FROM ends e JOIN stored s ON s.global_id = e.global_id WHERE e.kind = 'update'", "ends", "stored"))
def update_replaces(spark, base):
    """Stored ids whose vector an update replaced last."""
    return _folded(spark, base).where("kind = 'update'").join(stored(spark, base).select(F.col("id").alias("global_id")), "global_id", "left_semi").select("global_id", "seq")


@register(query(f"SELECT index_id, seq, (SELECT max(global_id) FROM stored) + row_number() OVER (ORDER BY seq) AS new_id FROM changes WHERE kind = 'insert' AND {usable('vector')}", "changes", "stored"))
def batch_add_ids(spark, base):
    """Consecutive ids after the greatest stored one for a batch of inserts, in order of seq."""
    rows = fold.changes(read(spark, base, "mutations")).where((F.col("kind") == "insert") & V.usable("vector", D)).select("index_id", "seq", F.lit(1).alias("one"), F.lit(0).alias("all"))
    placed = running(rows, ["all"], "seq", [], "one", "place")
    top = stored(spark, base).agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
    return placed.select("index_id", "seq", (F.lit(top) + F.col("place") + 1).alias("new_id"))


@register(query("SELECT DISTINCT global_id FROM changes WHERE kind = 'delete' AND global_id NOT IN (SELECT global_id FROM vectors WHERE global_id IS NOT NULL) AND global_id NOT IN (SELECT global_id FROM effective WHERE kind <> 'delete')", "changes", "effective"))
def invalid_ids(spark, base):
    """Deletes of ids that never existed."""
    changed = fold.states_of_changes(read(spark, base, "mutations"))
    dead = changed.where("state.kind = 'delete'").select("global_id").distinct()
    known = read(spark, base, "vectors").select("global_id").unionByName(changed.where("state.kind <> 'delete'").select("global_id"))
    return dead.join(known.where("global_id is not null"), "global_id", "left_anti")


@register(query(f"""SELECT global_id, vector FROM (SELECT *, row_number() OVER (PARTITION BY global_id ORDER BY timestamp_ns DESC, seq DESC) AS r FROM (
  SELECT c.* FROM changes c JOIN last USING (index_id) WHERE timestamp_ns > taken AND (kind = 'delete' OR {usable("vector")}))) WHERE r = 1 AND kind <> 'delete'""", "changes", "last"))
def replay_after_snapshot(spark, base):
    """The state of what was changed strictly after each index's last complete checkpoint."""
    from vecloom.sources.tables import last_checkpoints

    taken = last_checkpoints(read(spark, base, "checkpoints")).select("index_id", "taken_ns")
    late = read(spark, base, "mutations").join(taken, "index_id").where("timestamp_ns > taken_ns")
    return fold.fold(fold.states_of_changes(late)).where("state.kind <> 'delete'").select("global_id", "state.vector")


def _dead(spark, base):
    return _folded(spark, base).where("kind = 'delete'").select(F.col("global_id").alias("id"))


@register(query("SELECT index_id, cluster, n, n_tomb, n_tomb / n::DOUBLE AS fraction FROM tombs", "tombs"))
def tombstone_fraction(spark, base):
    return maintain.live_counts(homes(spark, base), _dead(spark, base))


@register(query("SELECT h.index_id, h.cluster, h.global_id FROM home h JOIN tombs t USING (index_id, cluster) WHERE t.n_tomb / t.n::DOUBLE >= 0.1 AND h.global_id NOT IN (SELECT global_id FROM dead)", "home", "tombs", "dead"))
def compacted_clusters(spark, base):
    return maintain.compacted(homes(spark, base).drop("sq_dist"), _dead(spark, base)).withColumnRenamed("id", "global_id")


@register(query("""SELECT index_id, cluster, max(n) AS n, list(m ORDER BY pos) AS mu FROM (
  SELECT index_id, cluster, pos, sum(x::DOUBLE::DECIMAL(28,12))::DOUBLE / count(*) AS m, count(*) AS n FROM (
    SELECT index_id, cluster, unnest(v) AS x, unnest(range(1, 33)) AS pos FROM (
      SELECT index_id, cluster, v FROM home UNION ALL SELECT h.index_id, h.cluster, e.vector FROM ends e JOIN home h ON h.global_id = e.global_id WHERE e.kind <> 'delete')) GROUP BY ALL) GROUP BY ALL""", "home", "ends"))
def running_centroid(spark, base):
    """Cluster means moved by later vectors of their members, from sums and counts alone."""
    first = _homed_vectors(spark, base).select("index_id", "cluster", "vec")
    later = fold.current(_folded(spark, base).where("kind <> 'base'")).select(F.col("global_id").alias("id"), F.col("vector").alias("vec"))
    return maintain.running_mean(first, homes(spark, base).join(later, "id").select("index_id", "cluster", "vec"), ["index_id", "cluster"])


@register("SELECT vec_id AS global_id, CASE WHEN label = 7 THEN list_transform(embedding, lambda x: (-x)::FLOAT) ELSE embedding END AS vector FROM embeddings WHERE label <> 3")
def snapshot_roundtrip(spark, base):
    """All embeddings added, one label deleted, a snapshot, the log truncated, one label's vectors negated: what a restart sees."""
    from vecloom.sources.store import Collection

    rows = read(spark, base, "embeddings").select(F.col("vec_id").alias("global_id"), F.col("embedding").alias("vector"), "label")
    kept = Collection(spark, shared_folder(spark, "collection"), D_EMB)
    kept.add(rows.select("global_id", "vector"))
    kept.delete(rows.where("label = 3").select("global_id"))
    kept.snapshot()
    kept.truncate_log()
    kept.update(rows.where("label = 7").select("global_id", F.transform("vector", lambda x: -x).alias("vector")))
    return Collection(spark, kept.folder, D_EMB).live()


@register(query("SELECT global_id, kind, seq FROM ends", "ends"))
def stream_mutations(spark, base):
    """The feed read as a stream, and the states after it, tombstones included."""
    from vecloom.streaming import feed as streamed

    rows = read(spark, base, "mutations")
    folder = shared_folder(spark, "feed")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/mutations.parquet*")
    streamed.fold_stream(stream, folder)
    return streamed.states(spark, folder).select("global_id", "kind", "seq")


# merging


def _cells(spark, base):
    """The checkpoints' clusters with the members and errors counted from the vectors."""
    return maintain.quantization_error(homes(spark, base)).join(centroids(spark, base).select("index_id", "cluster", F.col("centroid").alias("mu")), ["index_id", "cluster"])


@register(query("SELECT index_id, a, b, sq FROM near_cells", "near_cells"))
def merge_pairs(spark, base):
    return maintain.merge_pairs(durable(_cells(spark, base)), 250.0)


def _gains(spark, base, cells=None):
    cells = cells or durable(_cells(spark, base))
    return maintain.merge_gain(maintain.merge_pairs(cells, 250.0), cells)


@register(query("SELECT index_id, a, b, sq, gain, passes FROM gains", "gains"))
def merge_gain(spark, base):
    return _gains(spark, base)


@register(query(f"""SELECT x.index_id, x.cluster, x.n + coalesce(y.n, 0) AS n,
  CASE WHEN y.n IS NULL THEN {"[" + ", ".join(f"x.mu[{i}]::DOUBLE" for i in range(1, D + 1)) + "]"} ELSE {"[" + ", ".join(f"(x.n * x.mu[{i}]::DOUBLE + y.n * y.mu[{i}]::DOUBLE) / (x.n + y.n)::DOUBLE" for i in range(1, D + 1)) + "]"} END AS mu
FROM cells x LEFT JOIN mplan p ON p.index_id = x.index_id AND p.kept = x.cluster LEFT JOIN cells y ON y.index_id = p.index_id AND y.cluster = p.folded
WHERE NOT EXISTS (SELECT 1 FROM mplan f WHERE f.index_id = x.index_id AND f.folded = x.cluster)""", "cells", "mplan"))
def merged_clusters(spark, base):
    cells = durable(_cells(spark, base))
    plan = durable(maintain.merge_plan(durable(_gains(spark, base, cells))))
    return maintain.merged(cells.withColumn("mu", V.doubles("mu")), plan)


# drift, building and tuning


def _displaced(spark, base):
    """(index_id, cluster, seq, v): inserted and updated vectors against their nearest loaded neighbour, else the centroid."""
    from vecloom.streaming import drift

    rows = fold.changes(read(spark, base, "mutations")).where((F.col("kind") != "delete") & V.usable("vector", D) & F.col("index_id").isNotNull())
    batch = durable(rows.select("index_id", F.col("global_id").alias("id"), F.col("vector").alias("vec"), "seq"))
    known, own = cells(spark, base), axes(spark, base)
    return drift.displacements(batch, cones.members(loaded(spark, base), known, own), known, own)


@register()
def oja_drift_state(spark, base):
    from vecloom.streaming import drift

    return drift.drift_states(_displaced(spark, base), axes(spark, base)).select("index_id", "cluster", "n", F.round("angle", 6).alias("angle"), "drifted")


@register()
def drift_alarm(spark, base):
    from vecloom.streaming import drift

    return drift.drift_states(_displaced(spark, base), axes(spark, base)).where("drifted").select("index_id", "cluster", F.round("angle", 6).alias("angle"))


@register()
def drift_profile(spark, base):
    """Percentiles of the angle between principal directions and axes, per index."""
    from vecloom.streaming import drift

    mu = centroids(spark, base).select("index_id", "cluster", "centroid")
    centred = _homed_vectors(spark, base).join(mu, ["index_id", "cluster"]).select("index_id", "cluster", V.centre("vec", "centroid").alias("v"))
    rows = drift.profile(centred, axes(spark, base), D)
    cut = F.percentile("angle", F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9, 0.99))))
    return rows.groupBy("index_id").agg(F.count("*").alias("clusters"), cut.alias("angles"), F.avg("explained").alias("explained"), F.avg((F.col("angle") > drift.ANGLE).cast("double")).alias("above"))


@register()
def chunked_build(spark, base):
    """An index built as chunks arrive: k-means on the first rows, one pass that assigns and projects, vectors and sketch written; live counts."""
    from vecloom.model import FanIndex

    rows = read(spark, base, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    folder = shared_folder(spark, "chunked")
    FanIndex.fit(rows, D_EMB, fans=16, sampling="head").save(folder)
    built = FanIndex.load(spark, folder, D_EMB)
    sketched = built.members().join(FanIndex.stored_sketch(spark, folder), "id").groupBy("cluster").agg(F.count("*").alias("sketched"))
    return built.tombstones().join(sketched, "cluster", "left").select("cluster", "n", "n_tomb", F.coalesce("sketched", F.lit(0)).alias("sketched"))


@register(query("SELECT index_id, (SELECT count(*) FROM ax) AS fans, count(*) AS n, max(nlist) AS nlist FROM stored LEFT JOIN (SELECT index_id, count(*) AS nlist FROM cents GROUP BY index_id) USING (index_id) GROUP BY index_id", "stored", "cents", "ax"))
def describe_index(spark, base):
    """What an index is made of."""
    lists = centroids(spark, base).groupBy("index_id").agg(F.count("*").alias("nlist"))
    n = stored(spark, base).groupBy("index_id").agg(F.count("*").alias("n"))
    return n.join(lists, "index_id", "left").select("index_id", F.lit(len(axes(spark, base))).cast("bigint").alias("fans"), "n", "nlist")


@register()
def tuner_suggest(spark, base):
    """The cheapest settings for each recall on the largest index: alpha and cones per vector tuned on a sample, the winner built and swept."""
    from vecloom.model import tune

    most = stored(spark, base).groupBy("index_id").count().orderBy(F.desc("count"), "index_id").first()
    if most is None:
        return spark.createDataFrame([], "target double, met boolean, cp int, fp int, w int, cands double, recall double, alpha double, cone_top_k int, nlist int, fans int")
    of = lambda df: df.where(F.col("index_id") == most["index_id"])
    got = tune(of(loaded(spark, base)).select("id", "vec"), of(asked(spark, base)).select(F.col("id").alias("qid"), F.col("vec").alias("q")), D)
    p = got.index.params
    chosen = evaluate.suggestions(got.sweep).select("target", "met", "cp", "fp", "w", "cands", "recall")
    return chosen.select("*", F.lit(float(got.alpha)).alias("alpha"), F.lit(p.cone_top_k).alias("cone_top_k"), F.lit(p.nlist).alias("nlist"), F.lit(p.fans).alias("fans"))
