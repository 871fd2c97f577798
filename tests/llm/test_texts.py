"""Leaks, mixes and language scores on small texts."""

import random
from datetime import UTC, datetime

import numpy as np
import pytest

from vecloom.llm import cnn, curriculum, fmindex, text

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, item_id string, tokens string, score string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, "clash", "clash", "clash") for i, t, lang, s in rows], DOCS)


# suffixes and the index


@pytest.mark.parametrize(("n", "sigma", "seed"), [(0, 2, 0), (1, 3, 0), (60, 3, 1), (500, 5, 2), (2_000, 40, 3)])
def test_index_against_scanning(n, sigma, seed):
    g = np.random.default_rng(seed)
    t = np.r_[g.integers(0, sigma - 1, n), sigma - 1]
    assert list(fmindex.sort_suffixes(t, sigma)) == sorted(range(len(t)), key=lambda i: list(t[i:]))
    index = fmindex.FMIndex(t, sigma, sample=7)
    patterns = g.integers(0, sigma - 1, (30, 3))
    lo, hi = index.count(patterns)
    for p, a, b in zip(patterns, lo, hi):
        assert sorted(index.locate(np.arange(a, b))) == [i for i in range(len(t) - 2) if (t[i : i + 3] == p).all()]


def test_wavelet_ranks():
    s = np.random.default_rng(0).integers(0, 19, 700)
    tree = fmindex.Wavelet.of(s, 19)
    for c in (0, 5, 18):
        at = np.arange(701)
        assert (tree.rank(np.full(701, c), at) == np.r_[0, np.cumsum(s == c)]).all()


def test_words():
    assert text.words("Caf\\'e \\emph{Na\u00efve} \\label{x:y}ﬁne co\\-operate % left\n% over", {"leftover"}) == ["cafe", "naive", "fine", "cooperate", "left", "over"]
    assert text.words("a left-\n% over right-\nhand", {"leftover"}) == ["a", "leftover", "right", "hand"]
    assert text.words("\\newcommand{\\zz}{plain}\nso \\zz{} it is")[-4:] == ["so", "plain", "it", "is"]
    assert text.words("") == []
    bomb = "\\newcommand{\\zz}{" + "boom " * 2_000 + "}" + "\\zz " * 4_000
    assert text.words(bomb).count("boom") == 2_000  # read where it is defined, not four thousand times
    assert text.word_stretches(bomb)[0] == text.words(bomb)
    long = "wordy " * 60
    assert len(text.words("\\newcommand{\\zz}{" + long + "}\n\\zz{} end")) == 181  # a macro of any length, where it is defined too


ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon."
OTHER = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen."
FILL = " ".join(f"word{i}" for i in range(40))


def find(spark, bodies, items=((1, ITEM), (2, OTHER), (3, None), (4, "too short"), (1, ITEM))):
    frame = docs(spark, [(i, b, "en", "s") for i, b in enumerate(bodies)])
    table = spark.createDataFrame([(i, "t", b, None, 7) for i, b in items], "item_id bigint, task string, text string, answer string, doc_id bigint")
    return sorted(map(tuple, fmindex.leaked_pairs(fmindex.leaks(frame, table)).collect()))


def test_leaks(spark):
    w = ITEM[:-1].split()
    cases = [
        f"{FILL} {' '.join(w[:12])} {FILL}",  # 0: just long enough
        f"{FILL} {' '.join(w[:11])} {FILL}",  # 1: too short
        f"% {' '.join(w[:6]).upper()}\n%% {' '.join(w[6:14])}\n{FILL}",  # 2: in a comment, other case
        " ".join(w[:5] + ["changed"] + w[6:12]) + f" {FILL}",  # 3: one word altered in twelve
        " ".join(w[:4] + ["changed"] + w[5:8] + ["again"] + w[9:12]) + f" {FILL}",  # 4: two altered in twelve
        " ".join(w[:6] + ["extra"] + w[6:16]) + f" {FILL}",  # 5: one word more
        " ".join(w[:6] + w[7:16]) + f" {FILL}",  # 6: one word less
        "\\emph{" + "} \\textbf{".join(w[:13]) + "}~--- " + OTHER,  # 7: marked up, and another item
        None, "", FILL, "\\iffalse " + ITEM + " \\fi",  # 8, 9, 10, 11
        " ".join(reversed(w)),  # 12: not in order
    ]
    assert find(spark, cases) == [(0, 1), (2, 1), (3, 1), (5, 1), (6, 1), (7, 1), (7, 2), (11, 1)]


def test_leaks_in_many_shards_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(fmindex, "SHARD", 300)
    rng = random.Random(1)
    noise = lambda n: " ".join(rng.choice(["alpha", "beta", "one", "two", "x", "y", "z"]) for _ in range(n))
    bodies = [noise(200) + (" " + ITEM + " " if i % 7 == 0 else " ") + noise(300) for i in range(40)] + [noise(20_000) + OTHER + noise(20_000)]
    assert find(spark, bodies) == [(i, 1) for i in range(0, 40, 7)] + [(40, 2)]


def test_spans_merge(spark):
    found = spark.createDataFrame([(1, 1, 5, 21, 12), (1, 2, 21, 40, 12), (1, 1, 50, 70, 12), (2, 1, 0, 13, 12)], fmindex.FOUND)
    assert sorted(map(tuple, fmindex.removal_spans(found).collect())) == [(1, 5, 40, 2), (1, 50, 70, 1), (2, 0, 13, 1)]


def test_spans_keep_to_the_passage():
    vocabulary = ITEM[:-1].lower().split()
    items = fmindex.Items.of([(1, ITEM)])
    n, other = items.vocabulary, [-1] * 30
    at = lambda words: [n[w] for w in words]
    w = vocabulary
    # the item's other words stand near their places outside the passage, by chance
    chance = other[:25] + at(w[:12]) + [-1] * 7 + at(w[19:]) + other
    extra = other + at(w[:6]) + [-1] + at(w[6:14]) + other
    beyond = other + at(w[:13]) + [-1] + at(w[13:16]) + other
    rows = fmindex.search_shard([np.array(x, np.int64) for x in (chance, extra, beyond)], items)
    span = {doc: (min(r[2] for r in rows if r[0] == doc), max(r[3] for r in rows if r[0] == doc)) for doc in (0, 1, 2)}
    assert span == {0: (25, 36), 1: (30, 44), 2: (30, 46)}
    assert {r[4] for r in rows if r[0] == 0} == {12}


def test_stretches_of_words():
    odd = "\\newcommand{\\zz}{plain words}\nCaf\\'e \\emph{Na\u00efve} \\label{x:y}\ufb01ne co\\-operate % left\n% over \\zz{} end-\n% ing right-\nhand \u0130x"
    for known in (frozenset(), {"ending"}):
        found, first, end = text.word_stretches(odd, known)
        assert found == text.words(odd, known)
        cut = {w: odd[a:z] for w, a, z in zip(found, first, end)}
        assert (cut["cafe"], cut["naive"], cut["fine"], cut["cooperate"], cut["right"]) == ("Caf\\'e", "Na\u00efve", "\ufb01ne", "co\\-operate", "right")
        assert cut.get("ending", "end-\n% ing") == "end-\n% ing" and odd[first[found.index("over") + 1] :].startswith("\\zz{}")
    assert text.word_stretches("")[0] == []


def test_spans_are_characters_of_the_source(spark):
    w = ITEM[:-1].split()
    passage = f"\\textbf{{{' '.join(w[:4])}}} {' '.join(w[4:9])}\n%% {' '.join(w[9:12])}"
    bodies = [f"{FILL}\n{passage}. {FILL}", f"\u00c4\u00f6 {FILL} {' '.join(w)} {FILL} {OTHER}"]
    table = spark.createDataFrame([(1, "t", ITEM, None, 7), (2, "t", OTHER, None, 7)], "item_id bigint, task string, text string, answer string, doc_id bigint")
    cut = fmindex.removal_spans(fmindex.leaks(docs(spark, [(i, b, "en", "s") for i, b in enumerate(bodies)]), table)).collect()
    got = sorted((r["doc_id"], bodies[r["doc_id"]][r["first_char"] : r["end_char"]]) for r in cut)
    assert got == [(0, passage[len("\\textbf{") :]), (1, ITEM[:-1]), (1, OTHER[:-1])]


def test_long_items_in_pieces(spark, monkeypatch):
    """An item far longer than a piece: passages at its start, middle and end, also when the items come in several passes."""
    rng = random.Random(4)
    long = [f"w{rng.randrange(10_000)}" for _ in range(3_000)]
    bodies = [f"{FILL} {' '.join(long[a : a + n])} {FILL}" for a, n in ((0, 12), (1_500, 13), (2_988, 12), (700, 400), (40, 30))] + [f"{FILL} {' '.join(long[a : a + 11])}" for a in (0, 99)]
    items = ((1, " ".join(long)), (2, ITEM), (3, OTHER))
    want = [(i, 1) for i in range(5)]
    assert find(spark, bodies, items) == want
    monkeypatch.setattr(fmindex, "ITEM_CHARS", 8_000)
    assert find(spark, bodies, items) == want
    one = fmindex.Items.of([(1, " ".join(long))])
    rows = fmindex.search_shard([np.array([one.vocabulary[x] for x in long[700:1_100]])], one)
    covered = set().union(*[range(r[2], r[3] + 1) for r in rows])
    assert covered == set(range(400))


def test_nothing_to_search(spark):
    assert find(spark, [FILL], items=((1, None),)) == []
    assert find(spark, [None]) == []


# mixing


def counted(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")


TARGETS = "plan string, corpus_multiple double, source string, target_share double, max_repeats int, supply int"


def test_token_counts(spark):
    rows = docs(spark, [(1, "hello world", "en", "A-b "), (2, None, "en", None), (3, "", "en", "a_B"), (4, "x" * 50_000, "en", " ")])
    got = {r[0]: (r[1], r[2]) for r in curriculum.token_counts(rows).collect()}
    assert got[1] == ("a_b", 2) and got[2] == (None, 0) and got[3] == ("a_b", 0) and got[4][0] is None and got[4][1] > 100


def test_offsets_are_running_sums(spark):
    rows = [(i, "hot" if i % 3 else "cold", i % 7) for i in range(500)] + [(999, None, 5)]
    got = curriculum.offsets(counted(spark, rows), ranges=16).collect()
    for source in ("hot", "cold"):
        part = sorted((r["offset"], r["tokens"]) for r in got if r["source"] == source)
        at = 0
        for offset, size in part:
            assert offset == at
            at += size
    assert len(got) == 500


def test_mix_reaches_shares(spark):
    rows = [(i, "big", 10 + i % 5) for i in range(3_000)] + [(10_000 + i, "small", 30) for i in range(50)] + [(20_000, None, 4_000)]
    targets = [("p", 0.5, "big", 0.7, 2, 1), ("p", 0.5, "Small ", 0.25, 3, 1), ("p", 0.5, "gone", 0.05, 3, 1), ("p", 0.5, "gone", 0.05, 3, 1), ("q", 1.0, "big", 1.0, 1, 1)]
    counts = counted(spark, rows)
    plans = curriculum.schedule(counts, spark.createDataFrame(targets, TARGETS))
    order = curriculum.training_order(curriculum.assignments(counts, plans))
    out = {(r["plan"], r["source"]): r for r in curriculum.report(order, plans).collect()}
    assert len(out) == 4
    total = sum(r[2] for r in rows)
    assert out["p", "big"]["demand"] == pytest.approx(0.35 * total) and abs(out["p", "big"]["placed_tokens"] - 0.35 * total) < 20
    small = out["p", "small"]
    assert small["short"] and small["placed_tokens"] == 4_500 and small["copies"] == 150 and 0 < small["reached"] < small["size"]
    assert out["p", "gone"]["short"] and (out["p", "gone"]["placed_tokens"], out["p", "gone"]["reached"]) == (0, 0.0)
    assert not out["p", "big"]["short"] and out["p", "big"]["reached"] == out["p", "big"]["size"] and out["q", "big"]["short"]
    assert out["p", "big"]["actual_share"] + small["actual_share"] == pytest.approx(1)
    # the sequence, by hand
    g = {(r["plan"], r["source"]): (r["g"], r["demand"], r["size"], r["supply"], r["max_repeats"]) for r in plans.collect()}
    offset = {r["doc_id"]: r["offset"] for r in curriculum.offsets(counts).collect()}
    want = []
    for (plan, source), (tilt, demand, size, supply, repeats) in g.items():
        for doc, name, tokens in rows:
            for copy in range(repeats if name == source else 0):
                if (start := offset[doc] + copy * supply) < demand:
                    low, high = 0.0, 1.0  # bisect the integral of the weight
                    for _ in range(60):
                        mid = (low + high) / 2
                        low, high = (mid, high) if mid + tilt * (mid * mid - mid) < start / demand else (low, mid)
                    want.append((plan, low * size, source, doc, copy, tokens))
    got = {p: sorted((r for r in order.collect() if r["plan"] == p), key=lambda r: r["place"]) for p in "pq"}
    for p in "pq":
        part = sorted(w for w in want if w[0] == p)
        assert [(r["doc_id"], r["copy"]) for r in got[p]] == [w[3:5] for w in part]
        assert [r["position"] for r in got[p]] == pytest.approx([w[1] for w in part], abs=1e-6)
        assert [r["place"] for r in got[p]] == [sum(w[5] for w in part[:n]) for n in range(len(part))]
    # the source of longer documents gains weight over time; the other leads
    assert out["p", "big"]["first_half_share"] > out["p", "big"]["second_half_share"]
    half = sum(r["tokens"] for r in got["p"]) / 2
    early = [r for r in got["p"] if r["place"] < half]
    assert out["p", "big"]["first_half_share"] == pytest.approx(sum(r["tokens"] for r in early if r["source"] == "big") / sum(r["tokens"] for r in early))


def test_shortage_is_exact(spark):
    """Exactly enough is enough, a token less is not."""
    rows = [(i, "a", 7) for i in range(10)] + [(100, "b", 70)]
    targets = [("p", 1.0, "a", 0.5, 1, 0), ("p", 1.0, "b", 0.5, 1, 0), ("q", 1.5, "a", 1.0, 3, 0), ("r", 1.0, "a", 0.5, 0, 0), ("s", 141 / 140, "a", 0.5, 1, 0)]
    counts = counted(spark, rows)
    plans = curriculum.schedule(counts, spark.createDataFrame(targets, TARGETS))
    out = {(r["plan"], r["source"]): r["short"] for r in curriculum.report(curriculum.training_order(curriculum.assignments(counts, plans)), plans).collect()}
    assert out == {("p", "a"): False, ("p", "b"): False, ("q", "a"): False, ("r", "a"): True, ("s", "a"): True}


def test_schedule_inverts(spark):
    for g in (-0.8, 0.0, 0.5):
        for part in (0.0, 0.3, 1.0):
            t = spark.range(1).select(curriculum.when_reached(curriculum.F.lit(part), curriculum.F.lit(g))).first()[0]
            assert t + g * (t * t - t) == pytest.approx(part)


def test_empty_mix(spark):
    plans = curriculum.schedule(counted(spark, []), spark.createDataFrame([("p", 1.0, "a", 1.0, 2, 0)], TARGETS))
    rows = curriculum.report(curriculum.training_order(curriculum.assignments(counted(spark, []), plans)), plans).collect()
    assert [(r["placed_tokens"], r["actual_share"], r["short"]) for r in rows] == [(0, 0.0, False)]


# language scores


def test_disguises():
    same = lambda a, b: list(cnn.hashed([a])[0]) == list(cnn.hashed([b])[0])
    for odd in ("You Z.ark of m u d d y", "YOU z4rk of mu\\-ddy", "you {\\rm za}rk of mud-\n% dy", "\\newcommand{\\zz}{zark}"[:0] + "you zark \\label of muddy"):
        assert same(odd, "you zark of muddy"), odd
    assert same("\\newcommand{\\zz}{zark} \\zz{} b", "\\newcommand{zark}{zark} zark b")
    assert [len(x) for x in cnn.hashed(["", "a b", "1 2 3"])] == [0, 2, 0]


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "bcdfghjkl" for b in ("orn", "ale", "ist", "umo", "ent", "ark")]
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(40, 90))]
        bad = i % 5 == 0
        if bad:
            at = rng.randrange(len(words))
            words[at:at] = ["you", rng.choice(["zarky", "quobbed", "vimmy"]), rng.choice(["snorp", "glab"])]
        elif i % 5 == 1:
            words[3:3] = ["the", "word", rng.choice(["snorp", "glab"]), "stands", "quoted"]
        out.append((" ".join(words), bad))
    return out


def test_classifier_learns_from_noisy_votes():
    rng = random.Random(0)
    rows = []
    for body, bad in corpus(360, 1):
        votes = [bad != (rng.random() < 0.1) for _ in range(rng.randrange(1, 4))]
        rows.append((cnn.hashed([body])[0], "en", sum(votes), len(votes) - sum(votes)))
    net = cnn.fit(rows, updates=150)
    held = corpus(200, 2)
    guess = net.scores(cnn.hashed([b for b, _ in held])) > net.thresholds.get("en", net.thresholds[""])
    truth = np.array([bad for _, bad in held])
    assert (guess & truth).sum() >= 0.85 * truth.sum() and (guess & ~truth).sum() <= 0.05 * len(held)


def test_scores_of_odd_texts_and_rates(spark):
    bodies = corpus(60, 3)
    rows = [(i, b, ["en", "EN", "en-US", "deu", None][i % 5], ["A-x", "a_x ", None][i % 3]) for i, (b, _) in enumerate(bodies)] + [(100, None, None, "a x"), (101, "", "xx", ""), (102, "9 9 9 \\x", "en", None), (103, "word " * 60_000, "en", "b")]
    labels = [(i, f"r{i % 3}", int(bad), None) for i, (_, bad) in enumerate(bodies)] * 2 + [(0, "r9", None, None), (1, "r8", 1, None), (1, "r8", 0, None), (None, "r1", 1, None), (777, "r1", 1, None)]
    frame, table = docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, rater string, abusive int, category string")
    sample = cnn.reviewed(frame, table)
    assert sample.count() == 60 and {(r["yes"], r["no"]) for r in sample.collect()} <= {(1, 0), (0, 1)}
    scores = cnn.scored(frame, cnn.fit_reviewed(frame, table))
    got = {r["doc_id"]: r for r in scores.collect()}
    assert len(got) == 64 and all(0 <= r["score"] <= 1 for r in got.values())
    assert not any(got[i]["abusive"] for i in (100, 101, 102)) and {r["language"] for r in got.values()} == {"en", "de", "other"}
    assert {r["threshold"] for r in got.values()} <= {"en", "de", "all"} and got[102]["language"] == "en" and got[101]["threshold"] == "all"
    by = {r["source"]: r["documents"] for r in cnn.rates(scores).collect()}
    assert by["a_x"] == 41 and by[None] == 22 and by["b"] == 1


def test_long_texts_in_pieces(monkeypatch):
    """A text scored in pieces, and many in portions, score as they do at once."""
    net = cnn.train([np.arange(1, 40), np.arange(40, 90)] * 3, np.array([1, 0] * 3, np.float32), updates=5)
    g = np.random.default_rng(0)
    docs = [g.integers(1, 100, n) for n in (0, 1, 3, 7, 50, 64, 65, 129, 300, 5)]
    once = net.scores(docs)
    for words in (7, 64, 100):
        monkeypatch.setattr(cnn, "WORDS", words)
        assert np.allclose(net.scores(docs), once, atol=1e-5)


@pytest.mark.parametrize("limit", [64 << 20, 32])
def test_every_reviewed_document_is_learned_from(spark, monkeypatch, limit):
    """More of either kind than a sample once took, and a text longer than it took; votes sent to every task, or shuffled."""
    monkeypatch.setattr(cnn, "SHIP_LIMIT", limit, raising=False)
    rows = [(i, f"word {'zarky' if i < 1_600 else 'stands'}", "en", "s") for i in range(4_800)] + [(9_000, "word " * 30_000, "en", "s"), (9_001, None, "en", "s"), (9_002, "", "en", "s")]
    labels = [(i, "r", int(i < 1_600), None) for i, _, _, _ in rows]
    sample = cnn.reviewed(docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, rater string, abusive int, category string")).collect()
    assert sorted(r["doc_id"] for r in sample) == [i for i, t, _, _ in rows if t is not None]
    assert {len(r["words"]) for r in sample if r["doc_id"] >= 9_000} == {60_000, 0} and sum(r["yes"] for r in sample) == 1_600


def test_training_goes_through_every_document(monkeypatch):
    """Also where blocks hold one kind only, and one kind is rare or missing."""
    for abusive in ({7, 130}, {299}, set(range(40)), set(), set(range(300))):
        seen, most = set(), []
        update = cnn.Training._update
        monkeypatch.setattr(cnn, "BLOCK", 40)
        monkeypatch.setattr(cnn.Training, "_update", lambda self, pick, seen=seen, most=most, update=update: (seen.update(len(d) for d, _ in pick), most.append(len(pick)), update(self, pick)))
        net = cnn.train([np.full(k + 1, 5) for k in range(300)], np.array([float(k in abusive) for k in range(300)]), updates=1)
        monkeypatch.undo()
        assert seen == set(range(1, 301)) and set(most) == {48} and np.isfinite(net.embedding).all()
        assert abusive and len(abusive) < 300 or (net.out == 0).all() and net.out_bias == (10 if abusive else -10)


def test_strongest_positions_in_pieces(monkeypatch):
    net, g = cnn.Network.fresh(3), np.random.default_rng(0)
    bodies = [g.integers(1, 1_000, n).astype(np.uint16) for n in (0, 1, 3, 7, 50, 64, 65, 129, 300, 5)]
    top, seen = net.strongest(bodies)
    assert np.allclose(np.maximum(top + net.bias, 0) @ net.out + net.out_bias, net.scores(bodies), atol=1e-5)
    for words in (7, 64, 100):
        monkeypatch.setattr(cnn, "WORDS", words)
        again, same = net.strongest(bodies)
        assert np.allclose(again, top, atol=1e-5)
        for k, w in enumerate(cnn.WIDTHS):
            cols = slice(k * cnn.FILTERS, (k + 1) * cnn.FILTERS)
            assert (same[1:, cols, :w] == seen[1:, cols, :w]).all()


def test_trainings_in_tasks_are_those_in_memory(spark):
    bodies = corpus(90, 4)
    frame = docs(spark, [(i, b, ["en", "de"][i % 2], "s") for i, (b, _) in enumerate(bodies)]).repartition(5)
    labels = spark.createDataFrame([(i, f"r{k}", int(bad), None) for i, (_, bad) in enumerate(bodies) for k in range(1 + i % 2)], "doc_id bigint, rater string, abusive int, category string")
    rows = sorted(cnn.reviewed(frame, labels).collect(), key=lambda r: r["h"])
    here = cnn.fit([(np.frombuffer(r["words"], "<u2"), r["language"], r["yes"], r["no"]) for r in rows], updates=15)
    there = cnn.fit_reviewed(frame, labels, updates=15)
    assert here.thresholds.keys() == there.thresholds.keys() and np.allclose([here.thresholds[k] for k in here.thresholds], [there.thresholds[k] for k in here.thresholds], atol=1e-3)
    assert np.allclose(here.embedding, there.embedding, atol=1e-3) and np.allclose(here.out, there.out, atol=1e-3)


def test_no_labels(spark):
    frame = docs(spark, [(1, "some words", "en", "s")])
    empty = spark.createDataFrame([], "doc_id bigint, rater string, abusive int, category string")
    few = spark.createDataFrame([(1, "r", 1, None)], "doc_id bigint, rater string, abusive int, category string")
    for labels in (empty, few):
        rows = cnn.scored(frame, cnn.fit_reviewed(frame, labels)).collect()
        assert [(r["abusive"], r["threshold"]) for r in rows] == [(False, "none")]
    assert cnn.scored(frame.limit(0), cnn.fit_reviewed(frame, empty)).count() == 0
    assert datetime.now(UTC)
