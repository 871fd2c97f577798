"""Searches at the index's own defaults, against exact search on the small tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vecloom.operators import projection
from vecloom.plans import reference

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


def pairs(spark, name):
    return {(r["qid"], r["global_id"]) for r in entry.queries()[name](spark, DATA).collect()}


def test_cone_searches_at_the_defaults(spark):
    true = pairs(spark, "exact_knn_l2")
    found, refined, near, few = (pairs(spark, n) for n in ("cone_search", "cone_search_refined", "cone_search_candidates", "cone_candidates"))
    assert few < near and near >= refined  # cones this small are candidates as a whole
    assert len(found & true) > len(pairs(spark, "adaptive_search") & true)
    assert refined == found  # no window of 200 is left before a cone is covered
    ranks = [r[0] for r in reference._default(spark, DATA)[1].select("cluster_rank").distinct().collect()]
    assert sorted(ranks) == list(range(1, 11))


def test_projection_windows_grow_with_the_index(spark):
    rows = [(g, 0, float(i), 1, i, i) for g, n in ((1, 40), (2, 400)) for i in range(n)] + [(g, 0, 20.5, 0, 7, 20) for g in (1, 2)]
    lists = projection.scaled(spark.createDataFrame(rows, "index_id int, axis int, p double, is_point int, who bigint, pos bigint"), ["index_id"], 0.02, 3)
    assert {(r["index_id"], r["w"]) for r in lists.select("index_id", "w").distinct().collect()} == {(1, 3), (2, 8)}
    ids = [sorted(r["id"] for r in projection.candidates(lists.where(F.col("index_id") == g), ["index_id", "w"], "w").collect()) for g in (1, 2)]
    assert ids == [list(range(17, 23)), list(range(12, 28))]


def test_projection_index_reaches_its_neighbours(spark):
    true = pairs(spark, "exact_knn_l2")
    assert len(pairs(spark, "projection_index_search") & true) >= 0.9 * len(true)


def test_scaled_candidates_shuffle_no_pairs(spark):
    plan = entry.queries()["projection_index_candidates"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    above = plan.partition("MapInArrow")[0]  # what is done with the pairs
    assert not any(x in above for x in ("Aggregate", "Join", "Repartition", "Sort"))


def test_scaled_candidates_are_the_windows(spark):
    """Repeated rows, ids with several vectors, queries and ids in several indexes, ties, infinite values; whole indexes and large ones."""
    d, g = 3, np.random.default_rng(5)
    points = [(int(g.integers(0, 3)), int(i), [float(v) for v in g.integers(-4, 5, d)]) for i in g.integers(0, 150, 400)]
    points += points[:40] + [(1, 3, [float("inf"), 1.0, 0.0]), (7, 1, [0.0] * d)]
    asks = [(int(g.integers(0, 3)), int(i), [float(v) for v in g.integers(-4, 5, d)]) for i in g.integers(0, 20, 30)] + [(8, 5, [0.0] * d)]
    p, q = spark.createDataFrame(points, "index_id int, id bigint, vec array<float>"), spark.createDataFrame(asks, "index_id int, qid bigint, vec array<float>")
    axes = projection.axis_table(spark, projection.random_axes(5, d))
    lists = projection.scaled(projection.sorted_lists(projection.projections(p.distinct(), axes, "vec", d), projection.projections(q, axes, "vec", d), ["index_id"]), ["index_id"], 0.05, 4)
    want = sorted(tuple(r) for r in projection.candidates(lists, ["index_id", "w"], "w").collect())
    assert len({w for _, w in lists.select("index_id", "w").distinct().collect()}) > 1 and len(want) > 500
    for whole, work in ((10_000, 10_000_000), (140, 300), (0, 10_000_000)):
        got = projection.scaled_candidates(p, q, axes, ["index_id"], 0.05, 4, d, whole, work)
        assert sorted(tuple(r) for r in got.select("qid", "id").collect()) == want
    assert sorted(tuple(r) for r in projection.wide_candidates(lists, ["index_id", "w"], "w", part=9, work=200).collect()) == want
    assert projection.scaled_candidates(p.limit(0), q, axes, ["index_id"], 0.05, 4, d).count() == 0
