"""Queries of the training-data problems and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import cnn, curriculum, fmindex, mcl, rabitq
from vecloom.operators import coarse
from vecloom.sources.tables import read


def _index(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(read(spark, base, t) for t in ("vectors", "checkpoints", "checkpoint_clusters"))


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    vectors, checkpoints, clusters = _index(spark, base)
    return rabitq.most_similar(vectors, rabitq.asked(read(spark, base, "queries")), checkpoints, clusters).select("qid", "global_id")


def p1_neighbours(spark: SparkSession, base: str) -> DataFrame:
    vectors, checkpoints, clusters = _index(spark, base)
    asking = coarse.usable_vectors(vectors, 32).where("id % 20 = 0").distinct()
    found = rabitq.most_similar(vectors, asking, checkpoints, clusters)
    return found.select("qid", F.col("rank").cast("int").alias("rank"), "global_id", "sq_dist")


def p1_codes(spark: SparkSession, base: str) -> DataFrame:
    return rabitq.codes_table(*_index(spark, base))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return mcl.similar_groups(*_index(spark, base)).groups()


def p3_clusters(spark: SparkSession, base: str) -> DataFrame:
    return mcl.similar_groups(*_index(spark, base)).described()


def _leaks(spark: SparkSession, base: str) -> DataFrame:
    return fmindex.leaks(read(spark, base, "documents"), read(spark, base, "eval_items"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return fmindex.leaked_pairs(_leaks(spark, base))


def p6_removal_spans(spark: SparkSession, base: str) -> DataFrame:
    return fmindex.removal_spans(_leaks(spark, base))


def _mix(spark: SparkSession, base: str) -> curriculum.Mix:
    return curriculum.Mix(read(spark, base, "documents"), read(spark, base, "mix_targets"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return _mix(spark, base).report().where("short").select("plan", "source")


def p7_report(spark: SparkSession, base: str) -> DataFrame:
    return _mix(spark, base).report()


def p7_training_order(spark: SparkSession, base: str) -> DataFrame:
    return _mix(spark, base).order()


def _scores(spark: SparkSession, base: str) -> DataFrame:
    documents = read(spark, base, "documents")
    return cnn.scored(documents, cnn.fit_reviewed(documents, read(spark, base, "review_labels")))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return _scores(spark, base).where("abusive and doc_id is not null").select("doc_id").distinct()


def p8_scores(spark: SparkSession, base: str) -> DataFrame:
    return _scores(spark, base).select("doc_id", "language", "score", "abusive", "threshold")


def p8_rates(spark: SparkSession, base: str) -> DataFrame:
    return cnn.rates(_scores(spark, base))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_neighbours, p1_codes, p3_found, p3_clusters, p6_found, p6_removal_spans, p7_found, p7_report, p7_training_order,
        p8_found, p8_scores, p8_rates,
    )
}

_USABLE = "coalesce(vector IS NOT NULL AND len(vector) = 32 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0, false)"
_SQ = " + ".join(f"(a.v[{i}]::DOUBLE - b.v[{i}]::DOUBLE) * (a.v[{i}]::DOUBLE - b.v[{i}]::DOUBLE)" for i in range(1, 33))
_STORED = f"stored AS (SELECT DISTINCT index_id, global_id, vector AS v FROM vectors WHERE global_id IS NOT NULL AND {_USABLE})"

ORACLE = {
    "p1_found": f"""
WITH {_STORED},
asked AS (SELECT qid, index_id, q AS v FROM queries WHERE q IS NOT NULL AND len(q) = 32),
ranked AS (
  SELECT qid, global_id, row_number() OVER (PARTITION BY qid ORDER BY d, global_id) AS r
  FROM (SELECT a.qid, b.global_id, min({_SQ}) AS d FROM asked a JOIN stored b USING (index_id) GROUP BY ALL))
SELECT qid, global_id FROM ranked WHERE r <= 10""",
    "p1_neighbours": f"""
WITH {_STORED},
ranked AS (
  SELECT qid, global_id, d AS sq_dist, row_number() OVER (PARTITION BY qid ORDER BY d, global_id)::INTEGER AS rank
  FROM (SELECT a.global_id AS qid, b.global_id, min({_SQ}) AS d FROM stored a JOIN stored b USING (index_id) WHERE a.global_id % 20 = 0 GROUP BY ALL))
SELECT qid, rank, global_id, sq_dist FROM ranked WHERE rank <= 10""",
    "p3_found": f"""
WITH RECURSIVE last AS (
  SELECT index_id, max_by(checkpoint_id, timestamp_ns) AS checkpoint_id FROM checkpoints WHERE finished IS NOT NULL GROUP BY index_id),
listed AS (SELECT DISTINCT index_id, unnest(global_ids) AS global_id FROM checkpoint_clusters JOIN last USING (checkpoint_id)),
{_STORED},
kept AS (SELECT s.* FROM stored s JOIN listed USING (index_id, global_id)),
linked AS (
  SELECT a.global_id AS a, b.global_id AS b FROM kept a JOIN kept b ON a.index_id = b.index_id AND a.global_id <> b.global_id
  WHERE abs(a.v[1] - b.v[1]) <= 1.5 AND abs(a.v[2] - b.v[2]) <= 1.5 AND {_SQ} <= 2.0),
reach AS (
  SELECT a AS node, a AS other FROM linked
  UNION
  SELECT r.node, l.b FROM reach r JOIN linked l ON l.a = r.other)
SELECT min(other) AS group_id, node AS global_id FROM reach GROUP BY node""",
}
