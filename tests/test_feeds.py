"""Change feeds: the fold, the interval ledger and what a checkpoint doesn't hold."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecloom.operators import feed, fold, intervals

FEED = "seq bigint, index_id int, op string, global_id bigint, vector array<float>, timestamp_ns bigint, arrived timestamp, writer string, state string"
CHECKPOINTS = "checkpoint_id bigint, index_id int, timestamp_ns bigint, finished timestamp"
T0 = datetime(2025, 1, 1, tzinfo=UTC)
NS0 = int(T0.timestamp()) * 10**9


def change(seq, op, gid, ts, vector=None, index=0, arrived=None):
    return (seq, index, op, gid, vector, ts, T0 + timedelta(seconds=seq if arrived is None else arrived), None, "clash")


def good(v):
    return v is not None and len(v) == 2 and all(x is not None and x == x for x in v)


def by_hand(base, rows):
    """(live vectors, last effective change) by applying changes one after another."""
    firsts = {}
    for seq, _, op, gid, vector, ts, *_ in rows:
        kind = {"i": "I", "insert": "I", "1": "I", "d": "D", "delete": "D", "2": "D", "u": "U", "update": "U", "3": "U"}.get((op or "").strip().lower())
        if kind and gid is not None:
            key = (gid, kind, ts, str(vector))
            firsts[key] = (min(firsts[key][0], seq), vector) if key in firsts else (seq, vector)
    live, last = dict(base), {}
    for (gid, kind, ts, _), (seq, vector) in sorted(firsts.items(), key=lambda x: (x[0][0], x[0][2], x[1][0])):
        if kind == "D":
            live.pop(gid, None)
        elif good(vector):
            live[gid] = vector
        else:
            continue
        last[gid] = (kind, seq)
    return live, last


def test_fold_is_sequential_application(spark):
    rng = random.Random(5)
    rows, base = [], [(g, 0, [float(g), 0.0], T0) for g in range(8)] + [(9, 0, None, None), (3, 0, [3.0, 0.0], T0)]
    for seq in range(300):
        v = rng.choice([None, [1.0], [float("nan"), 1.0], [float(rng.randrange(3)), 1.0]])
        rows.append(change(seq, rng.choice(["I", " insert", "1", "U", "Update ", "3", "D", "delete", "2", "H", "heartbeat", None]), rng.choice([None, 0, 0, 0, *range(12)]), rng.randrange(40), v))
    rows += [r[:0] + (r[0] + 1000, *r[1:]) for r in rows[:100]]  # delivered again
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, FEED)
    loaded = spark.createDataFrame(base, "global_id bigint, index_id int, vector array<float>, added timestamp")
    live, last = by_hand({g: v for g, _, v, _ in base if good(v)}, rows)
    folded = fold.apply_feed(loaded, log, d=2)
    assert {r[0]: r[1] for r in fold.current(folded).collect()} == live
    assert {r[0]: r[1] for r in folded.where("kind in ('insert', 'update')").select("global_id", "seq").collect()} == {g: s for g, (k, s) in last.items() if k != "D"}


def test_fold_commutes_and_keeps_tombstones(spark):
    rows = [change(1, "I", 1, 10, [1.0, 1.0]), change(2, "D", 1, 30), change(3, "U", 1, 20, [2.0, 2.0]), change(4, "I", 2, 5, [0.0, 0.0])]
    parts = [fold.states_of_changes(spark.createDataFrame([r], FEED), 2) for r in rows]
    forward, backward = fold.fold(fold.fold(*parts[:2]), *parts[2:]), fold.fold(*parts[::-1])
    assert sorted(forward.collect()) == sorted(backward.collect())
    assert {r[0]: r["state"]["kind"] for r in forward.collect()} == {1: "delete", 2: "insert"}
    assert fold.fold(fold.states_of_changes(spark.createDataFrame([], FEED), 2)).count() == 0


def test_merge_and_subtract(spark):
    frame = lambda rows: spark.createDataFrame(rows, "key bigint, lo bigint, hi bigint")
    big = intervals.BLOCK
    rows = [(1, 1, 5), (1, 6, 9), (1, 8, 3 * big), (1, 3 * big + 2, 3 * big + 2), (2, 5, 4), (2, None, 3), (2, 7, 7)]
    assert sorted(map(tuple, intervals.merge(frame(rows)).collect())) == [(1, 1, 3 * big), (1, 3 * big + 2, 3 * big + 2), (2, 7, 7)]
    left = intervals.subtract(frame([(1, 0, 4 * big), (2, 0, 9)]), frame(rows))
    assert sorted(map(tuple, left.collect())) == [(1, 0, 0), (1, 3 * big + 1, 3 * big + 1), (1, 3 * big + 3, 4 * big), (2, 0, 6), (2, 8, 9)]
    assert intervals.subtract(frame([]), frame(rows)).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)))
def test_flags_match_membership(spark, there, done):
    old, intervals.BLOCK = intervals.BLOCK, 7
    try:
        rows = spark.createDataFrame([(1, s, s in done) for s in sorted(there)], "key bigint, seq bigint, done boolean")
        ledger = intervals.islands(rows, "done")
        flagged = intervals.flag_inside(rows, ledger, "inside").collect()
        assert len(flagged) == len(there) and all(r["inside"] == r["done"] for r in flagged)
    finally:
        intervals.BLOCK = old


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 90), st.integers(0, 40)), max_size=12), st.lists(st.tuples(st.integers(0, 1), st.integers(0, 90), st.integers(0, 40)), max_size=12))
def test_ledger_arithmetic_over_blocks(spark, have, done):
    """Merging and subtracting intervals that reach over many blocks is merging and subtracting sets."""
    old, intervals.BLOCK = intervals.BLOCK, 7
    try:
        frame = lambda rows: spark.createDataFrame([(k, lo, lo + n) for k, lo, n in rows], "key bigint, lo bigint, hi bigint")
        numbers = lambda rows: {(k, i) for k, lo, n in rows for i in range(lo, lo + n + 1)}
        for got, want in ((intervals.merge(frame(have)), numbers(have)), (intervals.subtract(frame(have), frame(done)), numbers(have) - numbers(done))):
            rows = [tuple(r) for r in got.collect()]
            assert sorted((k, i) for k, lo, hi in rows for i in range(lo, hi + 1)) == sorted(want)
            assert all((k, hi + 1) not in want for k, _, hi in rows)  # none touches another
    finally:
        intervals.BLOCK = old


def test_a_million_intervals_of_one_key(spark):
    """Every second number is done: no task holds a key, and the answer is exact."""
    n = 1_000_000
    rows = spark.range(2 * n, numPartitions=8).selectExpr("1L as key", "id as seq", "id % 2 = 0 as done")
    ledger = intervals.islands(rows, "done")
    gaps = intervals.subtract(rows.groupBy("key").agg({"seq": "min"}).selectExpr("key", "0L as lo", f"{2 * n - 1}L as hi"), ledger)
    assert tuple(gaps.selectExpr("count(*)", "sum(hi - lo)", "min(lo)", "max(hi)", "sum(lo % 2)").first()) == (n, 0, 1, 2 * n - 1, n)
    wide = intervals.merge(ledger.unionByName(gaps)).collect()
    assert [tuple(r) for r in wide] == [(1, 0, 2 * n - 1)]


def test_ledger_neither_skips_nor_repeats(spark, tmp_path):
    book = intervals.Ledger(spark, str(tmp_path / "ledger"))
    source = lambda seqs: spark.createDataFrame([(k, s, f"{k}-{s}") for k, s in seqs], "key bigint, seq bigint, body string")
    process = lambda df: df.select("key", "seq", "body")
    first = [(1, 1), (1, 2), (1, 5), (2, 1), (None, 4), (2, None)]
    book.run(source(first), process)

    def die():
        raise RuntimeError("lost")

    later = [*first, (1, 3), (1, 6), (2, 9)]  # 3 commits late
    with pytest.raises(RuntimeError):
        book.run(source(later), process, before_commit=die)
    book.run(source(later), process)
    book.run(source(later), process)
    seen = [(r[0], r[1]) for p in book.outputs() for r in spark.read.parquet(p).collect()]
    assert sorted(seen) == [(1, 1), (1, 2), (1, 3), (1, 5), (1, 6), (2, 1), (2, 9)]
    assert sorted(map(tuple, book.processed().collect())) == [(1, 1, 3), (1, 5, 6), (2, 1, 1), (2, 9, 9)]


def test_new_changes(spark):
    rows = [
        change(1, "I", 1, 5, [1.0, 1.0]), change(2, "I", 1, 5, [1.0, 1.0]), change(9, "insert", 1, 5, [1.0, 1.0]),  # held, delivered again later
        change(3, "D", 1, 6, arrived=3), change(8, "U", 4, 1, [float("nan"), 0.0]), change(10, "3", 4, 1, [float("nan"), 0.0]), change(11, "H", None, 1),
        change(12, "I", 7, 1, None, index=1),  # no complete checkpoint
    ]
    checkpoints = [(1, 0, NS0 + 4 * 10**9, T0), (2, 0, NS0 + 100 * 10**9, None), (1, 0, NS0 + 4 * 10**9, T0), (3, 1, NS0 + 10**12, None)]
    got = feed.new_changes(spark.createDataFrame(rows, FEED), spark.createDataFrame(checkpoints, CHECKPOINTS))
    assert sorted(r[0] for r in got.collect()) == [8, 12]
    assert feed.new_changes(spark.createDataFrame([], FEED), spark.createDataFrame([], CHECKPOINTS)).count() == 0


def test_deliveries_without_an_index_are_new(spark):
    rows = [change(1, "I", 1, 10, [1.0, 1.0], index=None), change(2, "I", 2, 20, [2.0, 2.0]), change(3, "I", 2, 20, [2.0, 2.0], index=None), change(4, "D", 3, 30, index=None), change(5, "D", 3, 30, index=None)]
    taken = spark.createDataFrame([(1, 0, NS0 + 100 * 10**9, T0 + timedelta(seconds=100))], CHECKPOINTS)
    assert sorted(r[0] for r in feed.new_changes(spark.createDataFrame(rows, FEED), taken).collect()) == [1, 4]
