"""Per-key profiles under skew."""

import random
from collections import defaultdict

from vecloom.operators import skew

ENTRIES = "checkpoint_id bigint, cluster int, fan int, global_id bigint, proj array<double>, key1 string"
CLUSTERS = "checkpoint_id bigint, cluster int, cluster_counts bigint, n_c bigint, members string"


def test_profile_with_a_key_over_all_partitions(spark):
    rng = random.Random(3)
    rows = [(1, 0, 0, rng.choice([None, *range(0, 900, 3)]), None, "x") for _ in range(4000)] + [(1, c, 0, c, None, None) for c in range(20)] + [(2, 5, 1, None, None, None), (None, 1, 1, 1, None, None)]
    frame = spark.createDataFrame(rows, ENTRIES).repartition(7)
    want = defaultdict(list)
    for a, b, _, g, *_ in rows:
        if a is not None:
            want[(a, b)].append(g)
    for parts in (1, 3, 11):
        got = {(r[0], r[1]): tuple(r)[2:] for r in skew.key_profile(frame, "checkpoint_id", "cluster", "global_id", parts).collect()}
        assert got.keys() == want.keys()
        for key, ids in want.items():
            known = sorted({g for g in ids if g is not None})
            steps = [b - a for a, b in zip(known, known[1:])]
            assert got[key] == (len(ids), len(known), known[0] if known else None, known[-1] if known else None, max(steps, default=0))


def test_one_value_repeated_is_spread(spark):
    frame = spark.createDataFrame([(1, 1, 0, 7, None, None)] * 3000, ENTRIES)
    got = skew.key_profile(frame, "checkpoint_id", "cluster", "global_id", 8).collect()
    assert [tuple(r) for r in got] == [(1, 1, 3000, 1, 7, 7, 0)]


def test_mismatches(spark):
    entries = spark.createDataFrame([(1, 0, 0, g, None, None) for g in (1, 1, 2)] + [(1, 1, 0, None, None, None)], ENTRIES)
    rows = [(1, 0, 2, 2, "m"), (1, 1, 0, 0, "m"), (1, 2, 0, 1, None), (1, 3, 0, 0, None), (1, 4, None, None, None), (1, 0, 2, 3, None), (1, 0, 2, 3, None), (2, 0, 5, 5, None), (1, None, 1, 1, None)]
    got = skew.count_mismatches(entries, spark.createDataFrame(rows, CLUSTERS))
    assert sorted(map(tuple, got.collect())) == [(1, 0), (1, 2)]
    assert skew.count_mismatches(spark.createDataFrame([], ENTRIES), spark.createDataFrame(rows, CLUSTERS)).count() == 0
