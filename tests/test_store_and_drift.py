"""The mutable collection on files, and drift states in batch and stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.sources.store import Collection, Numbered
from vecloom.operators import coarse, cones
from vecloom.streaming import drift

D = 4


def frame(spark, rows):
    return spark.createDataFrame(rows, "global_id bigint, vector array<float>")


def test_snapshot_and_replay(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), D)
    assert c.live().count() == 0 and c.describe()["n"] == 0
    c.add(frame(spark, [(i, [float(i)] * D) for i in range(10)]))
    c.delete(frame(spark, [(2, None), (99, None)]).select("global_id"))
    c.snapshot()
    c.truncate_log()
    c.update(frame(spark, [(3, [7.0] * D)]))
    c.delete(frame(spark, [(4, None)]).select("global_id"))
    c.add(frame(spark, [(50, [1.0] * D)]))
    again = Collection(spark, str(tmp_path / "c"), D)  # deletes before the snapshot stay deleted
    live = {r[0]: r[1] for r in again.live().collect()}
    assert set(live) == {0, 1, 3, 5, 6, 7, 8, 9, 50} and live[3] == [7.0] * D
    again.snapshot()
    assert {r[0]: r[1] for r in again.live().collect()} == live
    assert again.describe() == {"n": 9, "n_deleted": 3, "d": D, "metric": "l2", "snapshots": 2}
    with pytest.raises(IndexError):
        c.delete(frame(spark, [(2, None)]).select("global_id"), strict=True)
    with pytest.raises(ValueError):
        c.add(frame(spark, [(60, [1.0])]))
    assert set(r[0] for r in again.live().collect()) == set(live)


def test_writers_meet_and_deaths(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "c")
    one, two = (Collection(spark, folder, D) for _ in range(2))
    one.add(frame(spark, [(1, [1.0] * D)]))
    # both see the same log; the second finds the number taken and goes on
    numbers = Numbered.numbers
    monkeypatch.setattr(Numbered, "numbers", lambda self: [1] if self.folder.endswith("log") else numbers(self))
    one.add(frame(spark, [(2, [2.0] * D), (1, [5.0] * D)]))
    two.add(frame(spark, [(3, [3.0] * D), (1, [4.0] * D)]))
    monkeypatch.undo()
    assert one._log.numbers() == [1, 2, 3]
    assert {r[0]: r[1][0] for r in two.live().collect()} == {1: 4.0, 2: 2.0, 3: 3.0}  # the later batch holds
    # a segment without a commit is nothing
    frame(spark, [(9, [9.0] * D)]).select(F.lit("insert").alias("op"), "global_id", "vector").write.parquet(f"{folder}/segments/lost")
    one.snapshot()
    # a truncation that dies halfway loses nothing
    monkeypatch.setattr(Numbered, "remove", lambda self, at: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        one.truncate_log()
    monkeypatch.undo()
    one.delete(frame(spark, [(3, None)]).select("global_id"))
    one.truncate_log()
    again = Collection(spark, folder, D)
    assert {r[0] for r in again.live().collect()} == {1, 2} and again.log().count() == 1
    with pytest.raises(ValueError, match="elements"):
        Collection(spark, folder, D + 1)
    with pytest.raises(ValueError, match="cosine"):
        Collection(spark, folder, D, "cosine")
    spark.read.parquet(again.newest()["data"]).limit(1).write.mode("append").parquet(again.newest()["data"])
    with pytest.raises(ValueError, match="rows"):
        Collection(spark, folder, D)


AXES = [(i, np.eye(D)[i].tolist()) for i in range(2)]


def moves(spark):
    rng = np.random.default_rng(0)
    steady = [(0, 0, i, (np.eye(D)[0] * 3 + rng.standard_normal(D) * 0.1).tolist()) for i in range(60)]
    turned = [(0, 1, i, (np.eye(D)[3] * 3 + rng.standard_normal(D) * 0.1).tolist()) for i in range(60)]
    still = [(0, 2, i, [0.0] * D) for i in range(3)]
    return spark.createDataFrame(steady + turned + still, "index_id int, cluster int, seq bigint, v array<double>")


def test_drift_alarm(spark):
    got = {r["cluster"]: r for r in drift.drift_states(moves(spark), AXES).collect()}
    assert not got[0]["drifted"] and got[1]["drifted"] and got[1]["angle"] > 60 and not got[2]["drifted"]
    assert [got[c]["n"] for c in (0, 1, 2)] == [60, 60, 3] and got[2]["u"] == []
    u = np.array(got[1]["u"]).reshape(D, 2)
    assert np.allclose(u.T @ u, np.eye(2))
    assert drift.drift_states(moves(spark).limit(0), AXES).count() == 0


def test_drift_in_chunks_is_drift_in_order(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((50, D)) + np.eye(D)[2] * 2
    frame_ = spark.createDataFrame([(0, 7, i, x.tolist()) for i, x in enumerate(v)], "index_id int, cluster int, seq bigint, v array<double>")
    u = None
    for a in range(0, 50, 8):
        u = drift._advance(u, v[a : a + 8], 2)
    whole = drift.drift_states(frame_, AXES, chunk=8).first()
    assert np.allclose(np.array(whole["u"]).reshape(D, 2), u) and whole["n"] == 50
    half = drift.drift_states(frame_.where("seq < 24"), AXES, chunk=8)
    assert np.allclose(drift.drift_states(frame_.where("seq >= 24"), AXES, chunk=8, before=half).first()["u"], whole["u"])


def test_displacements(spark):
    """From the nearest other member in the cones, from the centroid where there is none."""
    vectors = spark.createDataFrame([(0, 1, [1.0, 0.0, 0.0, 0.0]), (0, 2, [1.5, 0.0, 0.0, 0.0]), (0, 3, [0.0, 9.0, 0.0, 0.0])], "index_id int, id bigint, vec array<float>")
    cents = spark.createDataFrame([(0, 0, [0.0, 0.0, 0.0, 0.0], 3), (0, 1, [0.0, 0.0, 50.0, 0.0], 0)], "index_id int, cluster int, centroid array<float>, stated bigint")
    known = coarse.counted(vectors, cents, D)
    batch = spark.createDataFrame([(0, 2, [1.5, 0.25, 0.0, 0.0], 10), (0, 8, [0.0, 0.0, 51.0, 0.0], 11), (0, 9, [1.25, 0.0, 0.0, 0.0], 12)], "index_id int, id bigint, vec array<float>, seq bigint")
    got = {r["seq"]: (r["cluster"], r["v"]) for r in drift.displacements(batch, cones.members(vectors, known, AXES, 1, D), known, AXES, 1, D).collect()}
    assert got == {10: (0, [0.5, 0.25, 0.0, 0.0]), 11: (1, [0.0, 0.0, 1.0, 0.0]), 12: (0, [0.25, 0.0, 0.0, 0.0])}


def test_drift_profile(spark):
    got = {r["cluster"]: r for r in drift.profile(moves(spark), AXES, D).collect()}
    assert set(got) == {0, 1} and got[0]["angle"] < 15 < 60 < got[1]["angle"] and got[1]["explained"] > 0.9


def test_drift_stream(spark, tmp_path):
    rows = moves(spark)
    rows.where("seq < 30").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def run():
        drift.drift_stream(stream(), AXES).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    run()
    rows.where("seq >= 30").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    out = spark.read.parquet(str(tmp_path / "out"))
    last = {r["cluster"]: r for r in out.orderBy("n").collect()}
    assert last[1]["n"] == 60 and last[1]["drifted"] and not last[0]["drifted"]
