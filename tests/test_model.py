"""The index object: recall, changes that show, deletes that never leak, keeping."""

import shutil

import numpy as np
import pytest

from vecloom.functions import sqlfunctions
from vecloom.model import GONE, FanIndex, Params, ProjectionIndex, lloyd
from vecloom.sources.raw import append_results, chunked, gaussian, read_floats
from vecloom.sources.store import Collection

D = 12


def vectors(n, seed, start=0, spread=1.0):
    g = np.random.default_rng(seed)
    return {start + i: (g.standard_normal(D) * spread).astype(np.float32) for i in range(n)}


def frame(spark, rows, names="id bigint, vec array<float>"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows.items()], names)


def truth(rows, queries, k):
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids], float)
    out = {}
    for q, v in queries.items():
        dist = ((x - v.astype(float)) ** 2).sum(1)
        out[q] = ids[np.lexsort((ids, dist))[:k]].tolist()
    return out


def recall(found, want, k):
    got = {}
    for r in found.collect():
        got.setdefault(r["qid"], set()).add(r["id"])
    return np.mean([len(got.get(q, set()) & set(ids)) / k for q, ids in want.items()])


@pytest.fixture(scope="module")
def built(spark):
    rows = vectors(1_500, 1)
    return rows, FanIndex.fit(frame(spark, rows), D, nlist=12, fans=6, cone_top_k=2, seed=3)


def test_recall(spark, built):
    rows, index = built
    queries = vectors(25, 2)
    asks, want = frame(spark, queries, "qid bigint, q array<float>"), truth(rows, queries, 10)
    assert recall(index.search(asks, 10, probes=12, fan_probes=6), want, 10) == 1.0  # everything visited
    some = index.search(asks, 10, window=100, probes=8, fan_probes=3)
    assert recall(some, want, 10) >= 0.8
    pairs = {(r[0], r[1]) for r in index.candidates(asks, 100, 8, 3).collect()}
    assert {(r["qid"], r["id"]) for r in some.collect()} <= pairs
    d = index.describe()
    assert (d["n"], d["n_deleted"], d["nlist"], d["fans"]) == (1_500, 0, 12, 6)


def test_changes_show(spark, tmp_path):
    rows = vectors(400, 4)
    index = FanIndex.fit(frame(spark, rows), D, nlist=8, fans=4)
    spike = {9_000: np.full(D, 50, np.float32), 9_001: np.r_[np.full(D - 1, 50), 51].astype(np.float32)}
    index.add(frame(spark, spike))
    ask = frame(spark, {1: spike[9_000]}, "qid bigint, q array<float>")
    assert [r["id"] for r in index.search(ask, 2, probes=2, fan_probes=1).orderBy("rank").collect()] == [9_000, 9_001]
    index.delete(spark.createDataFrame([(9_000,), (9_000,), (77_777,)], "id bigint"))
    assert [r["id"] for r in index.search(ask, 1, probes=2, fan_probes=4).collect()] == [9_001]
    with pytest.raises(IndexError):
        index.delete(spark.createDataFrame([(9_000,)], "id bigint"), strict=True)
    with pytest.raises(ValueError):
        index.add(spark.createDataFrame([(1, [1.0])], "id bigint, vec array<float>"))
    index.update(frame(spark, {5: np.full(D, 70, np.float32)}))
    assert [r["id"] for r in index.search(frame(spark, {1: np.full(D, 70, np.float32)}, "qid bigint, q array<float>"), 1, probes=1, fan_probes=1).collect()] == [5]
    # a saved index keeps its deletes
    index.save(str(tmp_path / "index"))
    again = FanIndex.load(spark, str(tmp_path / "index"))
    assert again.describe() == index.describe() and again.describe()["n_deleted"] == 1
    asks = frame(spark, vectors(5, 6), "qid bigint, q array<float>")
    assert sorted(map(tuple, again.search(asks, 5).collect())) == sorted(map(tuple, index.search(asks, 5).collect()))
    again.delete(again.members().orderBy("id").limit(150).select("id"))
    left = again.describe()["n"]
    again.refresh()
    assert again.describe()["n"] == left and again.describe()["n_deleted"] < 151
    sketch = {r["id"]: r["sketch"] for r in FanIndex.stored_sketch(spark, str(tmp_path / "index")).collect()}
    shutil.rmtree(tmp_path / "index" / "sketch")
    assert {r["id"]: r["sketch"] for r in FanIndex.stored_sketch(spark, str(tmp_path / "index")).collect()} == sketch and 9_001 in sketch
    with pytest.raises(ValueError):
        FanIndex.load(spark, str(tmp_path / "index"), D + 1)
    spark.createDataFrame([(1, 1, True, 1)], GONE).write.mode("append").parquet(str(tmp_path / "index" / "gone"))
    with pytest.raises(ValueError, match="rows"):
        FanIndex.load(spark, str(tmp_path / "index"))


def test_drifted_clusters_get_axes_of_their_own(spark, tmp_path):
    g = np.random.default_rng(0)
    rows = {i: np.r_[g.standard_normal(3), np.zeros(D - 3)].astype(np.float32) for i in range(120)}
    log = Collection(spark, str(tmp_path / "log"), D)
    index = FanIndex.fit(frame(spark, rows), D, nlist=2, fans=3, seed=1, log=log, merge_interval=1_000)
    later = {1_000 + i: np.r_[np.zeros(D - 1), 2 + 0.2 * i].astype(np.float32) for i in range(60)}
    index.add(frame(spark, later))
    assert index.own and log.live().count() == 60
    c, axes = next(iter(index.own.items()))
    assert np.allclose(np.array(axes) @ np.array(axes).T, np.eye(3)) and abs(axes[0][D - 1]) > 0.9
    assert index.cluster_axes(c) == axes and index.cluster_axes(99) == [a for _, a in index.axes]
    asks = {1: later[1_030], 2: rows[7]}
    want = truth(rows | later, asks, 5)
    assert recall(index.search(frame(spark, asks, "qid bigint, q array<float>"), 5, probes=2, fan_probes=3), want, 5) == 1.0
    assert recall(index.search(frame(spark, asks, "qid bigint, q array<float>"), 5, probes=2, fan_probes=2, sketch=True), want, 5) >= 0.8
    held = {r["id"] for r in index.point_cones(spark.createDataFrame([(1_030,)], "id bigint")).collect()}
    assert held == {1_030} and sum(r["n"] for r in index.tombstones().collect()) == 180
    assert sum(index.cone(c, f).count() for f in range(3)) == index.cluster_members(c).count()
    for bad in (lambda: index.cone(c, 3), lambda: index.cluster_members(77)):
        with pytest.raises(IndexError):
            bad()
    index.set_merging(interval=5, eps=0.5)
    assert index.params.merge_interval == 5
    with pytest.raises(ValueError):
        index.set_merging(ratio=2.0)


def test_chunks_and_gaussian(spark):
    x = np.random.default_rng(2).standard_normal((1_030, D)).astype(np.float32)
    rows = chunked(spark, lambda a, z: x[a:z], 1_030, D, 100)
    got = {r["id"]: r["vec"] for r in rows.collect()}
    assert len(got) == 1_030 and all(np.array_equal(got[i], x[i]) for i in range(0, 1_030, 97))
    index = FanIndex.fit(rows, D, nlist=8, fans=4, sampling="head")
    assert index.describe()["n"] == 1_030 and index.sketch().count() == 1_030
    normal = np.array([r["vec"] for r in gaussian(spark, 2_000, 3).collect()])
    assert normal.shape == (2_000, 3) and abs(normal.mean()) < 0.1 and abs(normal.std() - 1) < 0.1


def test_twin_clusters_merge(spark):
    g = np.random.default_rng(0)
    rows = {i: (g.standard_normal(D) * 0.1).astype(np.float32) for i in range(200)}
    index = FanIndex.fit(frame(spark, rows), D, nlist=2, fans=4, merge_eps=1.0)
    queries = {q: rows[q] for q in range(15)}
    folded = index.merge()
    assert folded == 1 and index.describe()["filled"] == 1
    assert recall(index.search(frame(spark, queries, "qid bigint, q array<float>"), 5, probes=1, fan_probes=4), truth(rows, queries, 5), 5) == 1.0


def test_cosine_and_odd_sizes(spark):
    rows = vectors(30, 8) | {500: np.zeros(D, np.float32)}
    index = FanIndex.fit(frame(spark, rows), D, nlist=100, fans=40, metric="cosine")
    assert index.params.nlist == 31 and index.params.fans == D
    out = index.search(frame(spark, {1: rows[3] * 7}, "qid bigint, q array<float>"), 50, probes=31, fan_probes=D).orderBy("rank").collect()
    assert len(out) == 31 and out[0]["id"] == 3 and out[0]["dist"] == pytest.approx(0, abs=1e-6) and all(0 <= r["dist"] <= 2 for r in out)
    with pytest.raises(ValueError):
        FanIndex.fit(frame(spark, rows).limit(0), D)
    with pytest.raises(ValueError):
        Params(4, 1, 1, merge_ratio=2.0)


def test_projection_index(spark):
    rows, queries = vectors(1_000, 9), vectors(10, 10)
    index = ProjectionIndex(frame(spark, rows), D, projections=16)
    asks = frame(spark, queries, "qid bigint, q array<float>")
    found = index.search(asks, 10, 80)
    assert recall(found, truth(rows, queries, 10), 10) >= 0.8
    assert {(r["qid"], r["id"]) for r in found.collect()} <= {(r[0], r[1]) for r in index.candidates(asks, 80).collect()}


def test_lloyd_reseeds():
    x = np.r_[np.zeros((50, 3)), np.ones((50, 3))]
    assert sorted(lloyd(x, 2, 0, False).sum(1).round(6).tolist()) in ([0.0, 3.0], [0.0, 0.0], [3.0, 3.0])


def test_sql_functions_and_raw_files(spark, tmp_path):
    sqlfunctions.register(spark)
    row = spark.sql("SELECT vec_dot(array(1D, 2D), array(3D, 4D)) a, vec_l2sq(array(1D, 2D), array(3D, 5D)) b, vec_norm(array(3D, 4D)) c, vec_centre(array(1D), array(3D)) d, vec_normalize(array(3D, 4D)) e, vec_normalize(array(0D)) f").first()
    assert tuple(row) == (11.0, 13.0, 5.0, [-2.0], [0.6, 0.8], [0.0])
    data = np.arange(24, dtype="<f4").reshape(6, 4)
    data.tofile(tmp_path / "flat.dat")
    got = {r["id"]: r["vec"] for r in read_floats(spark, str(tmp_path / "flat.dat"), 4).collect()}
    assert got == {i: v.tolist() for i, v in enumerate(data)}
    append_results(spark.createDataFrame([(1, 0.5)], "cp int, recall double"), str(tmp_path / "log"))
    append_results(spark.createDataFrame([(2, 0.7)], "cp int, recall double"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
