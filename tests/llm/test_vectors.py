"""Vector search and clustering against brute force."""

import numpy as np
import pytest

from vecloom.llm import mcl, rabitq
from vecloom.operators import coarse

D = 32
VECTORS = "global_id bigint, index_id int, vector array<float>, added timestamp, cluster string"
CHECKPOINTS = "checkpoint_id bigint, index_id int, timestamp_ns bigint, finished timestamp, side int"
CLUSTERS = "checkpoint_id bigint, cluster int, centroids array<float>, cluster_counts bigint, n_c bigint, global_ids array<bigint>, index_id int"


def world(spark, n=900, centres=6, seed=0, indexes=2, tight=False):
    """Vectors around centres in multiples of 1/64, dirty rows among them; checkpoints listing all but every 10th id."""
    from datetime import datetime

    g = np.random.default_rng(seed)
    mu = np.round(g.standard_normal((indexes, centres, D)) * 3 * 64) / 64
    rows, lists = [], {}
    for i in range(n):
        x, c = i % indexes, int(g.integers(centres))
        v = mu[x, c] + (g.standard_normal(D) if not tight or i % 3 else np.round(g.standard_normal(D)) * (i % 9 == 0) * 0.05)
        v = np.round(v * 64) / 64
        rows.append((i, x, [float(a) for a in v], None, "clash"))
        if i % 10:
            lists.setdefault((x, c), []).append(i)
    copies = [(n + i, rows[5][1], rows[5][2], None, None) for i in range(40)]
    lists.setdefault((rows[5][1], 0), []).extend(r[0] for r in copies)
    dirty = [(5000, 0, None, None, None), (5001, 0, [1.0], None, None), (5002, 0, [float("nan")] * D, None, None), (5003, 0, [0.0] * D, None, None), (None, 0, [0.0] * D, None, None), (5004, 7, rows[0][2], None, None)]
    everything = rows + copies + dirty + rows[:50]
    now = datetime(2025, 1, 1)
    cps = [(10 + x, x, 100, now, 1) for x in range(indexes)] + [(90 + x, x, 200, None, 1) for x in range(indexes)] + [(10, 0, 100, now, 1)]
    body = [(10 + x, c, [float(a) for a in mu[x, c]], len(ids), len(ids), [*ids, ids[0], None], 3) for (x, c), ids in lists.items()] + [(90, 0, None, None, None, None, None), (10, 99, [0.0] * D, 0, 0, [], None)]
    return spark.createDataFrame(everything, VECTORS), spark.createDataFrame(cps, CHECKPOINTS), spark.createDataFrame(body + body[:2], CLUSTERS), everything, {i for ids in lists.values() for i in ids}


def usable(rows):
    return {(r[0], r[1]): np.array(r[2]) for r in rows if r[0] is not None and r[2] is not None and len(r[2]) == D and not np.isnan(r[2]).any()}


@pytest.mark.parametrize(("d", "words"), [(D, 2), (128, 2), (200, 4), (784, 13)])
def test_bounds_hold(d, words):
    g = np.random.default_rng(0)
    x, q = g.standard_normal((500, d)), g.standard_normal((40, d))
    x[0] = x.mean(0)
    codes, norms, align = rabitq.encode(x, x.mean(0))
    assert codes.shape == (500, words) and codes.dtype == np.uint64
    low, high = rabitq.bounds(codes, norms, align, q, x.mean(0))
    true = ((q[:, None] - x[None]) ** 2).sum(2)
    assert ((low <= true + 1e-6) & (true <= high + 1e-6)).mean() > 0.985
    ids = np.arange(500)
    qi, gid, dist, compared = rabitq.search_block(ids, x, np.arange(40), q, 10)
    exact = np.argsort(true, axis=1, kind="stable")[:, :10]
    assert np.mean([len(set(gid[qi == k]) & set(exact[k])) / 10 for k in range(40)]) > 0.98
    assert d > D or compared < 0.8 * true.size


@pytest.mark.parametrize(("limit", "block", "asking"), [(1 << 24, 8_192, 1 << 18), (0, 8_192, 1 << 18), (1 << 24, 16, 9)])
def test_search_matches_brute_force(spark, monkeypatch, limit, block, asking):
    monkeypatch.setattr(coarse, "SHIP_LIMIT", limit)
    monkeypatch.setattr(rabitq, "BLOCK", block)
    monkeypatch.setattr(rabitq, "ASKING", asking)
    vectors, checkpoints, clusters, rows, _ = world(spark)
    known = usable(rows)
    asks = [(q, q % 2, [float(a) for a in np.round(known[(q, q % 2)] * 64 + 3) / 64]) for q in range(0, 200, 5)] + [(900, 0, None), (901, 0, [1.0]), (902, 7, rows[0][2]), (903, 55, rows[0][2]), (904, None, rows[0][2])]
    found = rabitq.most_similar(vectors, rabitq.asked(spark.createDataFrame(asks, "qid bigint, index_id int, q array<float>")), checkpoints, clusters).collect()
    got = {}
    for r in found:
        got.setdefault(r["qid"], {})[r["rank"]] = r["global_id"]
    hits = 0
    for q, index, v in asks[:-5]:
        best = sorted((float(((np.array(v) - x) ** 2).sum()), i) for (i, at), x in known.items() if at == index)[:10]
        hits += len({i for _, i in best} & set(got[q].values()))
        assert len(got[q]) == 10
    assert hits >= 0.99 * 10 * (len(asks) - 5)
    assert got[902] == {1: 5004} and not {900, 901, 903, 904} & set(got)


@pytest.mark.parametrize("limit", [1 << 24, 0])
def test_checkpoints_that_state_wrong_sizes(spark, monkeypatch, limit):
    """Everything in one cell stated to be empty, the others stated to be huge: work is split by what is counted, and nobody goes short."""
    from datetime import datetime

    monkeypatch.setattr(coarse, "SHIP_LIMIT", limit)
    monkeypatch.setattr(rabitq, "BLOCK", 50)
    monkeypatch.setattr(rabitq, "SEEN", 5)
    g = np.random.default_rng(3)
    rows = [(i, 0, [float(a) for a in np.round(g.standard_normal(D) * 64) / 64], None, None) for i in range(300)]
    rows += [(1_000 + i, 0, [float(a) for a in [20.0 + i, *[0.0] * (D - 1)]], None, None) for i in range(4)] + [(2_000, 0, [20.0] * D, None, None)] * 30
    vectors = spark.createDataFrame(rows, VECTORS)
    checkpoints = spark.createDataFrame([(1, 0, 5, datetime(2025, 1, 1), 0)], CHECKPOINTS)
    body = [(1, c, [c * 20.0, *[0.0] * (D - 1)], n, n, [], None) for c, n in ((0, 0), (1, 10**7), (2, None))] + [(1, 3, [20.0] * D, 5, 5, [], None)]
    clusters = spark.createDataFrame(body, CLUSTERS)
    cells = coarse.counted(coarse.usable_vectors(vectors, D), coarse.centroid_rows(checkpoints, clusters, D), D)
    sizes = coarse.over_cells(coarse.usable_vectors(vectors, D), cells, D, lambda c, i, ids, x: [c.clusters, c.sizes], "cluster int, n bigint", 2).distinct()
    assert sorted(map(tuple, sizes.collect())) == [(0, 300), (1, 4), (2, 0), (3, 30)]
    asks = spark.createDataFrame([(0, 1, [20.0] * D), (0, 2, [0.0] * D), (0, 3, [20.0, *[0.0] * (D - 1)])], "index_id int, id bigint, vec array<float>")
    found = rabitq.most_similar(vectors, asks, checkpoints, clusters, probes=1).collect()
    known = usable(rows)
    for q, v in ((1, [20.0] * D), (2, [0.0] * D), (3, [20.0, *[0.0] * (D - 1)])):
        best = sorted((float(((np.array(v) - x) ** 2).sum()), i) for (i, _), x in known.items())[:10]
        got = [r["global_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["qid"] == q]
        assert len(got) == 10 == len(set(got)) and len(set(got) & {i for _, i in best}) >= 9


def test_codes_of_long_vectors(spark):
    g = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, 0, [float(a) for a in g.standard_normal(200)], None, None) for i in range(20)], VECTORS)
    _, checkpoints, clusters, *_ = world(spark, n=20)
    rows = rabitq.codes_table(vectors, checkpoints.limit(0), clusters.limit(0), 200).collect()
    assert len(rows) == 20 and {len(r["code"]) for r in rows} == {4}
    found = rabitq.most_similar(vectors, coarse.usable_vectors(vectors, 200), checkpoints.limit(0), clusters.limit(0), 3, 200)
    assert all(r["qid"] == r["global_id"] for r in found.where("rank = 1").collect()) and found.count() == 60


def test_search_of_nothing(spark):
    vectors, checkpoints, clusters, *_ = world(spark, n=60)
    none = rabitq.asked(spark.createDataFrame([], "qid bigint, index_id int, q array<float>"))
    assert rabitq.most_similar(vectors, none, checkpoints, clusters).count() == 0
    some = rabitq.asked(spark.createDataFrame([(1, 0, [0.0] * D)], "qid bigint, index_id int, q array<float>"))
    assert rabitq.most_similar(vectors.limit(0), some, checkpoints.limit(0), clusters.limit(0)).count() == 0


def groups_by_hand(rows, listed, radius_sq=2.0):
    known = [(i, at, x) for (i, at), x in usable(rows).items() if i in listed]
    root = {i: i for i, _, _ in known}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, at, x) in enumerate(known):
        for j, other, y in known[n + 1 :]:
            if at == other and float(((x - y) ** 2).sum()) <= radius_sq:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    out = {}
    for i, _, _ in known:
        out.setdefault(find(i), []).append(i)
    return {(g, i) for g, ids in out.items() if len(ids) > 1 for i in ids}


@pytest.mark.parametrize("band", [1 << 20, 0])
def test_groups_match_brute_force(spark, monkeypatch, band):
    monkeypatch.setattr(mcl, "BAND_ROWS", band)
    vectors, checkpoints, clusters, rows, listed = world(spark, n=400, tight=True)
    found = mcl.similar_groups(vectors, checkpoints, clusters)
    got = sorted(map(tuple, found.groups().collect()))
    assert len(got) == len(set(got)) and set(got) == groups_by_hand(rows, listed)
    sizes = {r["cluster_id"]: (r["size"], r["typical"]) for r in found.described().collect()}
    assert sum(s for s, _ in sizes.values()) == len(got) and all(1 <= len(t) <= 3 for _, t in sizes.values())


def test_groups_through_chains(spark):
    """A chain across cells: neighbours are linked, ends are not; flow may cut it, the groups may not."""
    from datetime import datetime

    steps = [[float(np.float32(k * 1.25)), *[0.0] * (D - 1)] for k in range(14)]
    vectors = spark.createDataFrame([(100 - k, 0, v, None, None) for k, v in enumerate(steps)], VECTORS)
    checkpoints = spark.createDataFrame([(1, 0, 5, datetime(2025, 1, 1), 0)], CHECKPOINTS)
    body = [(1, c, [c * 4.0, *[0.0] * (D - 1)], 3, 3, [100 - k for k in range(14)], None) for c in range(5)]
    found = mcl.similar_groups(vectors, checkpoints, spark.createDataFrame(body, CLUSTERS))
    assert sorted(map(tuple, found.groups().collect())) == [(87, g) for g in range(87, 101)]
    assert found.described().count() > 1


def test_flow_separates_two_cliques(spark):
    pairs = [(a, b) for base in (0, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 10)]
    edges = spark.createDataFrame(pairs, "a bigint, b bigint")
    weights = spark.createDataFrame([(n, 1) for n in (*range(5), *range(10, 15))], "node bigint, weight bigint")
    label = {r["node"]: r["cluster"] for r in mcl.attractors(mcl.markov_flow(edges, weights)).collect()}
    assert len({label[n] for n in range(5)}) == 1 == len({label[n] for n in range(10, 15)}) and label[0] != label[12]


def whole_flow(x, radius_sq=2.0, inflation=2.0):
    """Markov clustering of all vectors, copies too, with dense matrices: the clusters as sets of places."""
    sq = ((x[:, None] - x[None]) ** 2).sum(2)
    m = (sq <= radius_sq).astype(float)
    m /= m.sum(0)
    for _ in range(200):
        new = (m @ m) ** inflation
        new /= new.sum(0)
        new[new < 1e-6] = 0
        new /= new.sum(0)
        moved, m = np.abs(new - m).max(), new
        if moved < 1e-9:
            break
    root = list(range(len(x)))
    for node, row in enumerate(np.round(m, 7).argmax(0)):
        a, b = root[node], root[row]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return {frozenset(np.flatnonzero(np.array(root) == r).tolist()) for r in set(root)}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_clusters_are_those_of_the_whole_flow(spark, seed):
    """Groups joined by bridges, with copies of some members: the same clusters as dense matrices over all vectors give."""
    from datetime import datetime

    g = np.random.default_rng(seed)
    spots = [np.r_[c * 2.6, np.zeros(D - 1)] + np.r_[g.standard_normal((6, 4)) * 0.35, np.zeros((0, 4))] @ np.eye(4, D) for c in range(4)]
    bridge = [np.r_[[1.3 + 2.6 * c], np.zeros(D - 1)] for c in range(3)]
    x = np.round(np.concatenate([*spots, np.array(bridge), spots[0][:1].repeat(5, 0), spots[2][:2], np.full((2, D), 9.0)]) * 64) / 64
    vectors = spark.createDataFrame([(i, 0, [float(a) for a in v], None, None) for i, v in enumerate(x)], VECTORS)
    checkpoints = spark.createDataFrame([(1, 0, 5, datetime(2025, 1, 1), 0)], CHECKPOINTS)
    body = [(1, c, [c * 5.0, *[0.0] * (D - 1)], 3, 3, list(range(len(x))), None) for c in range(3)]
    found = mcl.similar_groups(vectors, checkpoints, spark.createDataFrame(body, CLUSTERS))
    got = {}
    for r in found.members.select("global_id", "cluster").distinct().collect():
        got.setdefault(r["cluster"], set()).add(r["global_id"])
    want = {c for c in whole_flow(x) if len(c) > 1}
    assert {frozenset(c) for c in got.values() if len(c) > 1} == want and len(want) >= 3
    sizes = {r["cluster_id"]: r["size"] for r in found.described().collect()}
    assert {min(c): len(c) for c in want} == {i: n for i, n in sizes.items() if n > 1}


def test_chains_of_attractors(spark):
    """Columns that lead to one another are one cluster, however long the way; a faint column keeps something."""
    chain = [(n, n + 1, 1.0) for n in range(1, 9)] + [(9, 9, 1.0), (20, 21, 0.6), (20, 20, 0.4), (21, 21, 1.0), (30, 30, 1.0)]
    flow = spark.createDataFrame(chain, "col bigint, row bigint, flow double")
    assert {r["node"]: r["cluster"] for r in mcl.attractors(flow).collect()} == {**{n: 1 for n in range(1, 10)}, 20: 20, 21: 20, 30: 30}
    hub = [(0, n) for n in range(1, 40)]
    weights = spark.createDataFrame([(n, 1) for n in range(40)], "node bigint, weight bigint")
    label = {r["node"]: r["cluster"] for r in mcl.attractors(mcl.markov_flow(spark.createDataFrame(hub, "a bigint, b bigint"), weights, prune=0.05)).collect()}
    assert set(label) == set(range(40)) and len(set(label.values())) < 40
    with pytest.raises(RuntimeError, match="settle"):
        mcl.markov_flow(spark.createDataFrame(hub, "a bigint, b bigint"), weights, most=0)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (20, 20), (30, 31), (31, 30), (5, 1)]
    got = {r["node"]: r["root"] for r in mcl.joined(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7, 30: 30, 31: 30}


def test_no_vectors_no_groups(spark):
    vectors, checkpoints, clusters, *_ = world(spark, n=40)
    found = mcl.similar_groups(vectors.limit(0), checkpoints, clusters)
    assert found.groups().count() == found.described().count() == 0
