"""Search, cones, evaluation and upkeep against plain numpy."""

import numpy as np
import pytest

from vecloom.functions import vecmath as V
from vecloom.model import tune
from vecloom.operators import coarse, cones, evaluate, exact, maintain, projection, search, tuner
from vecloom.operators.positions import running

D = 8


def points(n=400, seed=1, groups=2):
    g = np.random.default_rng(seed)
    return [(int(i % groups), int(i), [float(v) for v in np.round(g.standard_normal(D) * 8) / 8]) for i in range(n)]


@pytest.fixture(scope="module")
def world(spark):
    rows = points()
    queries = [(grp, 1000 + i, vec) for i, (grp, _, vec) in enumerate(points(24, seed=2))]
    vectors = spark.createDataFrame(rows, "index_id int, id bigint, vec array<float>").cache()
    asks = spark.createDataFrame(queries, "index_id int, id bigint, vec array<float>").cache()
    mu = [(grp, c, [float(x) for x in np.round(np.random.default_rng(9 + grp).standard_normal((5, D))[c] * 8) / 8], 80) for grp in range(2) for c in range(5)]
    cents = spark.createDataFrame(mu, "index_id int, cluster int, centroid array<float>, stated bigint").cache()
    own = projection.random_axes(4, D, seed=3, orthonormal=True)
    own = np.round(own * 4096) / 4096
    return {"rows": rows, "queries": queries, "vectors": vectors, "asks": asks, "mu": mu, "cents": cents, "axes": [(i, a.tolist()) for i, a in enumerate(own)]}


def brute(world, k, metric="l2", qs=None):
    out = {}
    for grp, q, v in qs or world["queries"]:
        best = []
        for g, i, x in world["rows"]:
            if g == grp:
                a, b = np.array(v), np.array(x)
                if metric == "cosine":
                    a, b = (z / (n if (n := np.linalg.norm(z)) >= 1e-10 else 1.0) for z in (a, b))
                best.append((round(float(((a - b) ** 2).sum()), 9), i))
        out[q] = sorted(best)[:k]
    return out


def asked_frame(df):
    return df.select(df["index_id"].alias("grp"), "id", "vec")


@pytest.mark.parametrize("metric", ["l2", "sqeuclidean", "cosine"])
def test_exact(spark, world, metric):
    got = exact.nearest(asked_frame(world["asks"]), asked_frame(world["vectors"]), 7, metric, D, blocks=3).collect()
    want = brute(world, 7, metric)
    assert len(got) == 7 * len(want)
    turn = {"l2": np.sqrt, "sqeuclidean": lambda x: x, "cosine": lambda x: x / 2}[metric]
    for r in got:
        sq, i = want[r["qid"]][r["rank"] - 1]
        assert r["dist"] == pytest.approx(turn(sq), abs=1e-8)
        assert metric == "cosine" or r["global_id"] == i


def test_exact_with_k_beyond_n_and_ties(spark):
    rows = spark.createDataFrame([(0, i, [1.0] * D) for i in (5, 3, 9)], "grp int, id bigint, vec array<float>")
    got = exact.nearest(rows.limit(1), rows, 10, "l2", D).collect()
    assert [(r["rank"], r["global_id"], r["dist"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 3, 0.0), (2, 5, 0.0), (3, 9, 0.0)]
    assert exact.nearest(rows.limit(0), rows, 3, "l2", D).count() == exact.nearest(rows, rows.limit(0), 3, "l2", D).count() == 0


def test_metric_names():
    assert [V.metric_name(m) for m in ("L2", " euclidean", "sqeuclidean", "Cosine")] == ["l2", "l2", "sqeuclidean", "cosine"]
    with pytest.raises(ValueError, match="cosine"):
        V.metric_name("manhattan")


def test_usable(spark):
    rows = [(0, None), (1, [1.0] * D), (2, [1.0]), (3, [1.0] * (D - 1) + [float("nan")]), (4, [0.0] * D), (5, [None] + [1.0] * (D - 1)), (6, [])]
    df = spark.createDataFrame(rows, "i int, v array<float>")
    assert [r[0] for r in df.where(V.usable("v", D)).orderBy("i").collect()] == [1, 4]


def test_running_positions(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i % 3 == 0), float(rng.integers(0, 9)), i, 1) for i in range(500)]
    got = running(spark.createDataFrame(rows, "k int, v double, i int, one int"), ["k"], "v", ["i"], "one", "place", ranges=8).collect()
    for key in (0, 1):
        order = sorted((r["v"], r["i"]) for r in got if r["k"] == key)
        assert {r["i"]: r["place"] for r in got if r["k"] == key} == {i: n for n, (_, i) in enumerate(order)}


def test_running_sums_of_one_value(spark):
    """A group whose rows all tie is cut into ranges like any other."""
    frame = spark.createDataFrame([("a" if i % 10 else "b", 1.0, i, i % 4) for i in range(900)], "k string, v double, i int, w int")
    got = running(frame, ["k"], "v", ["i"], "w", "at", ranges=8).collect()
    for key in "ab":
        total = 0
        for r in sorted((r for r in got if r["k"] == key), key=lambda r: r["i"]):
            assert r["at"] == total
            total += r["w"]
    assert running(frame.limit(0), ["k"], "v", ["i"], "w", "at").count() == 0


def test_windows_are_slices_of_sorted_lists(spark, world):
    table = projection.axis_table(spark, np.array([a for _, a in world["axes"]]))
    p = projection.projections(world["vectors"], table, "vec", D)
    q = projection.projections(world["asks"].withColumnRenamed("id", "qid"), table, "vec", D)
    lists = projection.sorted_lists(p, q, ["index_id"], carry=True)
    got = {(r[0], r[1]) for r in projection.candidates(lists, ["index_id"], 6).collect()}
    assert projection.window_counts(lists, ["index_id"], 6).agg({"n": "sum"}).first()[0] == projection.window_members(lists, ["index_id"], 6).count()
    best = {}
    for r in projection.nearest_in_windows(lists, ["index_id"], 6, 3, D, width=5).collect():
        best.setdefault(r["qid"], []).append((r["sq"], r["id"]))
    bodies = {i: np.array(x) for _, i, x in world["rows"]}
    for _, qid, v in world["queries"]:
        by_hand = sorted((((bodies[i] - np.array(v)) ** 2).sum(), i) for q_, i in got if q_ == qid)[:3]
        assert [i for _, i in sorted(best[qid])[:3]] == [i for _, i in by_hand]
    want = set()
    for grp, qid, v in world["queries"]:
        for _, a in world["axes"]:
            rank = sorted((float(np.dot(x, a)), i) for g, i, x in world["rows"] if g == grp)
            at = np.searchsorted([r[0] for r in rank], float(np.dot(v, a)))
            want |= {(qid, i) for _, i in rank[max(0, at - 6) : at + 6]}
    assert len(got ^ want) <= 0.002 * len(want)  # equal but for sums that differ in the last bit


def test_cells_shipped_and_met_agree(spark, world):
    near = lambda limit: sorted(map(tuple, coarse.over_cells(world["vectors"], coarse.prepare(world["cents"], D, limit), D, visit, "index_id int, id bigint, cluster int", 4).collect()))

    def visit(cells, index, ids, x):
        return [np.full(len(ids), index, np.int32), ids, cells.clusters[cells.distances(x.astype(float)).argmin(1)]]

    assert near(1 << 20) == near(0) and len(near(0)) == 400


def slow_search(world, known, clusters, fans, windows, k):
    """Windows, stopping test and ranking of one query after another, in plain loops."""
    cells = {}
    for grp, c, mu, _ in world["mu"]:
        cells.setdefault(grp, []).append((c, np.array(mu)))
    axes = np.array([a for _, a in world["axes"]])
    dots = lambda v: [sum(x * y for x, y in zip(v, a)) for a in axes]
    score = lambda v: [-abs(p) / (n if (n := np.sqrt(sum(x * x for x in v))) >= 1e-10 else 1.0) for p in dots(v)]
    homes = {}
    for grp, i, x in world["rows"]:
        c, mu = min(cells[grp], key=lambda m: (((np.array(x) - m[1]) ** 2).sum(), m[0]))
        v = np.array(x) - mu
        for f in np.argsort(score(v), kind="stable")[:2]:
            homes.setdefault((grp, c, int(f)), []).append((i, dots(v), np.array(x)))
    out = {}
    for grp, q, x in world["queries"]:
        cones_ = []
        for c, mu in sorted(cells[grp], key=lambda m: (((np.array(x) - m[1]) ** 2).sum(), m[0]))[:clusters]:
            v = np.array(x) - mu
            cones_ += [(homes[grp, c, int(f)], dots(v)) for f in np.argsort(score(v), kind="stable")[:fans] if (grp, c, int(f)) in homes]
        for w in windows:
            found, gaps = {}, []
            for members, p in cones_:
                if len(members) <= 2 * w:
                    found |= {i: y for i, _, y in members}
                    continue
                per_axis = []
                for a in range(len(axes)):
                    right = sorted((m[1][a] - p[a], m[0]) for m in members if m[1][a] >= p[a])
                    left = sorted(((m[1][a] - p[a], m[0]) for m in members if m[1][a] < p[a]), reverse=True)
                    body = {m[0]: m[2] for m in members}
                    found |= {i: body[i] for _, i in right[:w] + left[:w]}
                    per_axis.append(min([abs(side[w][0]) for side in (right, left) if len(side) > w], default=np.inf))
                gaps.append(max(per_axis))
            ranked = sorted((((y - np.array(x)) ** 2).sum(), i) for i, y in found.items())
            kth = np.sqrt(ranked[k - 1][0]) if len(ranked) >= k else None
            if kth is None or min(gaps, default=np.inf) >= kth or w == windows[-1]:
                out[q] = (w, kth is not None and min(gaps, default=np.inf) >= kth, [i for _, i in ranked[:k]], set(found))
                break
    return out


@pytest.mark.parametrize(("limit", "part"), [(1 << 20, 65_536), (0, 65_536), (1 << 20, 7)])
def test_cone_search(spark, world, monkeypatch, limit, part):
    monkeypatch.setattr(coarse, "SHIP_LIMIT", limit)
    monkeypatch.setattr(cones, "PART_ROWS", part)
    twice = world["vectors"].union(world["vectors"].limit(60))  # repeated rows count once
    known = coarse.counted(twice, world["cents"], D)
    members = cones.members(twice, known, world["axes"], 2, D).cache()
    assert cones.by_cone(members).where("cluster >= 0").count() == 920
    where = lambda clusters, fans: cones.visits(world["asks"], known, world["axes"], clusters, fans, D)
    rows = lambda df: {(r["qid"], r["rank"]): r["id"] for r in df.collect()}
    truth = brute(world, 5)
    exact_rows = {(q, n + 1): i for q, best in truth.items() for n, (_, i) in enumerate(best)}
    # all clusters and cones and a window beyond every cone: the exact answer
    assert rows(search.adaptive(members, where(5, 4), 5, 400, D)) == exact_rows
    assert rows(search.adaptive(members, where(5, 1), 5, 0, D, whole=True)) == exact_rows
    some = where(2, 2)
    windows = search.window_levels(3, 12)
    got = search.adaptive(members, some, 3, 12, D).collect()
    want = slow_search(world, known, 2, 2, windows, 3)
    found = {q: [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["qid"] == q] for q in want}
    if part == 65_536:
        assert {q: (w, sure, ids) for q, (w, sure, ids, _) in want.items()} == {q: next((r["w"], r["certified"]) for r in got if r["qid"] == q) + (found[q],) for q in want}
        assert any(sure for _, sure, *_ in want.values()) and len({w for w, *_ in want.values()}) > 1
    pairs = {(r[0], r[1]) for r in search.candidates(members, some, 4, D).collect()}
    plain = {(q, i) for q, (*_, ids) in slow_search(world, known, 2, 2, [4], 3).items() for i in ids}
    assert pairs == plain if part == 65_536 else pairs >= plain  # a cluster in parts gives more, never less
    assert {(r["qid"], r["n"]) for r in search.candidate_counts(members, some, 4, D).collect()} == {(q, len({i for p, i in pairs if p == q})) for q, _ in pairs}
    # the sketch changes nothing but the work
    own = projection.random_axes(4, D, 1, True)
    spared = search.adaptive(members, some, 5, 10, D, sketch=own)
    assert rows(spared) == rows(search.adaptive(members, some, 5, 10, D, fixed=True))


def test_search_of_nothing(spark, world):
    known = coarse.counted(world["vectors"], world["cents"], D)
    members, asks = cones.members(world["vectors"], known, world["axes"], 2, D), cones.visits(world["asks"], known, world["axes"], 2, 2, D)
    assert search.adaptive(members.limit(0), asks, 5, 10, D).count() == search.adaptive(members, asks.limit(0), 5, 10, D).count() == 0
    # an index without centroids is one cell around the origin
    lost = world["vectors"].selectExpr("index_id + 7 as index_id", "id", "vec")
    alone = coarse.counted(lost, world["cents"], D)
    sizes = coarse.over_cells(lost, alone, D, lambda cells, index, ids, x: [np.array([index], np.int32), cells.clusters[:1], cells.sizes[:1]], "index_id int, cluster int, n bigint").distinct()
    assert sorted(map(tuple, sizes.collect())) == [(7, -1, 200), (8, -1, 200)]


def test_axes():
    assert len(projection.random_axes(16, 8, orthonormal=True)) == 8
    q = projection.random_axes(4, 8, orthonormal=True)
    assert np.allclose(q @ q.T, np.eye(4)) and np.allclose(np.linalg.norm(projection.random_axes(5, 3), axis=1), 1)


def test_fill(spark):
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    got = search.filled(frame([(1, 1, 5)], "qid bigint, rank int, id bigint"), frame([(1, 0), (2, 0), (3, 9)], "qid bigint, index_id int"), frame([(0, i) for i in (5, 1, 8)], "index_id int, id bigint"), 3)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 5, False), (1, 2, 1, True), (1, 3, 8, True), (2, 1, 1, True), (2, 2, 5, True), (2, 3, 8, True)]


def test_sweep_choices(spark):
    sweep = spark.createDataFrame([(1, 10.0, 0.5), (2, 20.0, 0.9), (3, 30.0, 0.9), (4, 40.0, 0.95), (5, 100.0, 0.96)], "cp int, cands double, recall double")
    front = evaluate.pareto(sweep)
    assert [r["cp"] for r in front.collect()] == [1, 2, 4, 5]
    assert [r["cp"] for r in evaluate.knee(front).collect()] == [2]
    assert {r["target"]: (r["cp"], r["met"]) for r in evaluate.suggestions(sweep).collect()} == {0.8: (2, True), 0.9: (2, True), 0.95: (4, True), 0.99: (5, False), 1.0: (5, False)}
    cube = spark.createDataFrame([(float(x), 3.0 * x**0.83) for x in (10, 100, 1000)] + [(0.0, 1.0)], "x double, y double")
    assert tuple(evaluate.scaling_exponent(cube).first()) == (0.83, "linear")


def test_upkeep(spark):
    rows = spark.createDataFrame([(0, 1, i, [float(i), 2.0]) for i in range(4)] + [(0, 2, 9, [5.0, 5.0])], "index_id int, cluster int, id bigint, vec array<float>")
    assert {r["cluster"]: (r["n"], r["mu"]) for r in maintain.means(rows, ["index_id", "cluster"], "vec").collect()} == {1: (4, [1.5, 2.0]), 2: (1, [5.0, 5.0])}
    more = maintain.running_mean(rows, rows.where("id = 3"), ["index_id", "cluster"])
    assert {r["cluster"]: (r["n"], r["mu"]) for r in more.collect()} == {1: (5, [1.8, 2.0]), 2: (1, [5.0, 5.0])}
    dead = spark.createDataFrame([(3,), (3,), (77,)], "id bigint")
    assert {r["cluster"]: r["fraction"] for r in maintain.live_counts(rows, dead).collect()} == {1: 0.25, 2: 0.0}
    assert sorted(r["id"] for r in maintain.compacted(rows, dead).collect()) == [0, 1, 2]
    cells = spark.createDataFrame([(0, 1, [0.0, 0.0], 3, 4.0), (0, 2, [1.0, 0.0], 1, 4.0), (0, 3, [1.5, 0.0], 1, 0.0), (0, 4, [0.0, 0.1], 0, 0.0)], "index_id int, cluster int, mu array<double>, n bigint, error double")
    gains = maintain.merge_gain(maintain.merge_pairs(cells, 1.5, 2), cells)
    plan = maintain.merge_plan(gains)
    assert sorted(map(tuple, plan.collect())) == [(0, 2, 3)]
    out = {r["cluster"]: (r["n"], r["mu"]) for r in maintain.merged(cells, plan).collect()}
    assert out == {1: (3, [0.0, 0.0]), 2: (2, [1.25, 0.0]), 4: (0, [0.0, 0.1])}


def test_tuner():
    assert tuner.scale_params(5_000, 64) == (16, 32, 15) and tuner.scale_params(1_000_000, 128) == (64, 128, 150)
    assert tuner.viable_fans(1_000, 30, 32) == 16 and tuner.viable_fans(100_000, 100, 128) == 128
    alpha, best, tried = tuner.tune_alpha(lambda a: -((a - 1.1) ** 2), 10)
    assert len(tried) == 10 and abs(alpha - 1.1) < 0.2
    assert (20, 16, 30) in tuner.settings(16, 15)
    assert tuner.tune_alpha(lambda a: a, 4, (0.5, 2.0))[0] == 2.0
    assert [tuner.sample_size(n) for n in (10, 5_000, 80_000, 10**7)] == [10, 5_000, 8_000, 50_000] and tuner.sample_size(10**7, 7_000) == 7_000
    at = np.array([0.1, 0.5, 0.9])
    mean, spread = tuner.Process().fit([0.1, 0.9], [1.0, 3.0]).predict(at)
    assert abs(mean[0] - 1) < 0.05 and abs(mean[2] - 3) < 0.05 and spread[1] > spread[0]


def test_tuning(spark):
    """The winner's settings: more looked at, more found; the widest finds everything; recalls are those of real searches."""
    g = np.random.default_rng(0)
    rows = {i: (g.standard_normal(D) + 4 * g.integers(0, 3, D)).astype(np.float32) for i in range(700)}
    asks = {i: rows[i * 13] + np.float32(0.1) for i in range(12)}
    frame = lambda r, names: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in r.items()], names)
    got = tune(frame(rows, "id bigint, vec array<float>"), frame(asks, "qid bigint, q array<float>"), D, count=4)
    assert len(got.trials) == 12 and {t[0] for t in got.trials} == {1, 2, 3} and all(0 <= t[2] <= 1 for t in got.trials)
    swept = {(r["cp"], r["fp"], r["w"]): r for r in got.sweep.collect()}
    p = got.index.params
    assert set(swept) == set(tuner.settings(p.fans, 15)) and p.nlist == round(got.alpha * np.sqrt(700))
    widest = swept[20, p.fans, 30]
    assert widest["recall"] >= 0.95 and all(r["cands"] <= widest["cands"] and r["recall"] <= widest["recall"] for r in swept.values())
    pairs = {(r[0], r[1]) for r in got.index.candidates(frame(asks, "qid bigint, q array<float>"), 15, 5, 2).collect()}
    assert swept[5, 2, 15]["cands"] == pytest.approx(len(pairs) / 12)
    x, ids = np.array(list(rows.values()), float), np.array(list(rows))
    want = {(q, int(i)) for q, v in asks.items() for i in ids[np.argsort(((x - v) ** 2).sum(1))[:10]]}
    assert swept[5, 2, 15]["recall"] == pytest.approx(len(pairs & want) / 120)


def test_quality(spark):
    schema = "qid bigint, rank int, id bigint, dist double"
    truth = spark.createDataFrame([(1, r, r, float(r)) for r in range(1, 5)] + [(2, 1, 9, 1.0)], schema)
    found = spark.createDataFrame([(1, 1, 1, 1.0), (1, 2, 3, 3.0), (1, 3, 2, 2.0), (2, 1, 8, 2.0)], schema)
    got = evaluate.quality(found, truth, (1, 3)).first()
    assert (got["r1"], got["r3"]) == (0.5, 0.75) and got["ratio"] == pytest.approx((2 / 2.5 + 2) / 2)
