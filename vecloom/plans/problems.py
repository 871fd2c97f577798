"""Queries of the general data problems: change feeds, incremental runs, skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecloom.operators import feed, fold, skew
from vecloom.sources.tables import read


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    folded = fold.apply_feed(read(spark, base, "vectors"), read(spark, base, "mutations"))
    return folded.where("kind in ('insert', 'update')").select("global_id", "seq")


def p2_current_state(spark: SparkSession, base: str) -> DataFrame:
    return fold.current(fold.apply_feed(read(spark, base, "vectors"), read(spark, base, "mutations")))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return feed.new_changes(read(spark, base, "mutations"), read(spark, base, "checkpoints"))


def p4_gaps(spark: SparkSession, base: str) -> DataFrame:
    return feed.gaps(read(spark, base, "mutations"), read(spark, base, "checkpoints"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return skew.count_mismatches(read(spark, base, "cone_entries"), read(spark, base, "checkpoint_clusters"))


def p5_member_counts(spark: SparkSession, base: str) -> DataFrame:
    return skew.member_counts(read(spark, base, "cone_entries"))


QUERIES = {f.__name__: f for f in (p2_found, p2_current_state, p4_found, p4_gaps, p5_found, p5_member_counts)}

_KIND = """CASE WHEN lower(trim(op)) IN ('i', 'insert', '1') THEN 'insert'
     WHEN lower(trim(op)) IN ('d', 'delete', '2') THEN 'delete'
     WHEN lower(trim(op)) IN ('u', 'update', '3') THEN 'update' END"""
_USABLE = "coalesce(vector IS NOT NULL AND len(vector) = 32 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0, false)"
_EFFECTIVE = f"""
WITH changes AS (
  SELECT global_id, kind, timestamp_ns, vector, min(seq) AS seq
  FROM (SELECT global_id, {_KIND} AS kind, timestamp_ns, vector, seq FROM mutations)
  WHERE global_id IS NOT NULL AND kind IS NOT NULL
  GROUP BY ALL),
effective AS (SELECT * FROM changes WHERE kind = 'delete' OR {_USABLE}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY global_id ORDER BY timestamp_ns DESC, seq DESC) AS r FROM effective),
ends AS (SELECT * FROM ranked WHERE r = 1)"""
_LAST = "last AS (SELECT index_id, max(timestamp_ns) AS taken FROM checkpoints WHERE finished IS NOT NULL AND timestamp_ns IS NOT NULL GROUP BY index_id)"

ORACLE = {
    "p2_found": f"{_EFFECTIVE} SELECT global_id, seq FROM ends WHERE kind <> 'delete'",
    "p2_current_state": f"""{_EFFECTIVE},
loaded AS (
  SELECT global_id, vector FROM (
    SELECT global_id, vector, row_number() OVER (PARTITION BY global_id ORDER BY coalesce(epoch_us(added), -1) DESC, vector DESC) AS r
    FROM vectors WHERE global_id IS NOT NULL AND {_USABLE}) WHERE r = 1)
SELECT global_id, vector FROM ends WHERE kind <> 'delete'
UNION ALL
SELECT global_id, vector FROM loaded WHERE global_id NOT IN (SELECT global_id FROM ends)""",
    "p4_found": f"""
WITH {_LAST},
rows_ AS (
  SELECT seq, global_id, {_KIND} AS kind, timestamp_ns, vector, coalesce(epoch_us(arrived) * 1000 <= taken, false) AS held
  FROM mutations LEFT JOIN last USING (index_id))
SELECT min(seq) AS seq FROM rows_ WHERE global_id IS NOT NULL AND kind IS NOT NULL
GROUP BY global_id, kind, timestamp_ns, vector HAVING NOT bool_or(held)""",
    "p4_gaps": f"""
WITH {_LAST},
flagged AS (
  SELECT index_id, seq, coalesce(epoch_us(arrived) * 1000 <= taken, false) AS held
  FROM mutations LEFT JOIN last USING (index_id) WHERE index_id IS NOT NULL AND seq IS NOT NULL),
marked AS (SELECT *, CASE WHEN lag(held) OVER (PARTITION BY index_id ORDER BY seq) = held THEN 0 ELSE 1 END AS new FROM flagged),
runs AS (SELECT *, sum(new) OVER (PARTITION BY index_id ORDER BY seq) AS run FROM marked),
spans AS (SELECT index_id, run, held, min(seq) AS lo, max(seq) AS hi FROM runs GROUP BY ALL),
wide AS (SELECT *, lag(hi) OVER (PARTITION BY index_id ORDER BY lo) AS before, lead(lo) OVER (PARTITION BY index_id ORDER BY lo) AS after FROM spans)
SELECT index_id, coalesce(before + 1, lo) AS lo, coalesce(after - 1, hi) AS hi FROM wide WHERE NOT held""",
    "p5_found": """
WITH counts AS (
  SELECT checkpoint_id, cluster, count(DISTINCT global_id) AS members FROM cone_entries
  WHERE checkpoint_id IS NOT NULL AND cluster IS NOT NULL GROUP BY ALL)
SELECT DISTINCT c.checkpoint_id, c.cluster
FROM checkpoint_clusters c LEFT JOIN counts m ON m.checkpoint_id = c.checkpoint_id AND m.cluster = c.cluster
WHERE c.checkpoint_id IN (SELECT checkpoint_id FROM counts) AND c.cluster IS NOT NULL
  AND (coalesce(m.members, 0) <> c.n_c OR coalesce(m.members, 0) <> c.cluster_counts)""",
    "p5_member_counts": """
WITH steps AS (
  SELECT checkpoint_id, cluster, global_id, global_id - lag(global_id) OVER (PARTITION BY checkpoint_id, cluster ORDER BY global_id NULLS FIRST) AS step
  FROM cone_entries WHERE checkpoint_id IS NOT NULL AND cluster IS NOT NULL)
SELECT checkpoint_id, cluster::BIGINT AS cluster, count(*) AS n_rows, count(DISTINCT global_id) AS members,
       min(global_id) AS first, max(global_id) AS last, coalesce(max(step), 0) AS widest
FROM steps GROUP BY ALL""",
}
