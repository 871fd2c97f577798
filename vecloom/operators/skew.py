"""Per-key results where a few keys hold most rows.

Rows are range-partitioned on (key, secondary order) by sampled quantiles: a heavy key simply spans many
partitions.  Each partition reduces its sorted rows to one partial state per key, and the states of a
key that was cut at partition borders are stitched in partition order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.sources.tables import durable, ship_code, slices

#: Keys and the secondary order are 64-bit integers; a missing secondary value sorts first and counts as none.
STATE = "part int, key1 bigint, key2 bigint, n_rows bigint, n_distinct bigint, first bigint, last bigint, widest bigint"


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial states of one sorted partition; a key's state is carried over batch borders."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    carry: tuple | None = None  # key1, key2, rows, distinct, first, last, widest
    names = ["part", "key1", "key2", "n_rows", "n_distinct", "first", "last", "widest"]
    schema = pa.schema([("part", pa.int32()), *[(n, pa.int64()) for n in names[1:]]])

    def out(states: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*states))
        return pa.RecordBatch.from_arrays([pa.array([part] * len(states), pa.int32()), *[pa.array(c, pa.int64()) for c in columns]], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        there = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        second = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        ends = np.r_[starts[1:], len(k1)]
        done = []
        for a, b in zip(starts.tolist(), ends.tolist()):
            values = second[a:b][there[a:b]]
            if len(values):
                steps = np.diff(values)
                state = (int(k1[a]), int(k2[a]), b - a, int((steps != 0).sum()) + 1, int(values[0]), int(values[-1]), int(steps.max(initial=0)))
            else:
                state = (int(k1[a]), int(k2[a]), b - a, 0, None, None, 0)
            if carry and carry[:2] == state[:2]:
                carry = _join(carry, state)
            else:
                if carry:
                    done.append(carry)
                carry = state
        if done:
            yield out(done)
    if carry:
        yield out([carry])


def _join(a: tuple, b: tuple) -> tuple:
    """Stitch two neighbouring states: a value on both sides of the border counts once, the step over it counts too."""
    if a[4] is None or b[4] is None:
        full = a if b[4] is None else b
        return (*a[:2], a[2] + b[2], *full[3:])
    return (*a[:2], a[2] + b[2], a[3] + b[3] - (a[5] == b[4]), a[4], b[5], max(a[6], b[6], b[4] - a[5]))


def key_profile(rows: DataFrame, key1: str, key2: str, second: str, partitions: int | None = None) -> DataFrame:
    """(key1, key2, n_rows, n_distinct, first, last, widest) over the rows with both keys.

    ``n_distinct``, ``first``, ``last`` and ``widest`` (the greatest step between neighbours in order) describe
    the non-null values of ``second``; a key that has none gets 0, null, null and 0.  Repeated rows count
    in ``n_rows`` only.  Rows with a null key are left out.  Columns keep the names given.
    """
    ship_code(rows.sparkSession)
    n = partitions or slices(rows.sparkSession)
    lean = rows.where(F.col(key1).isNotNull() & F.col(key2).isNotNull()).select(F.col(key1).cast("bigint").alias("key1"), F.col(key2).cast("bigint").alias("key2"), F.col(second).cast("bigint").alias("second"))
    # the order ends in a hash, so that not even a single repeated (key, second) fills a partition by itself
    spread = lean.withColumn("tie", F.monotonically_increasing_id() % 1024).repartitionByRange(n, "key1", "key2", "second", "tie")
    states = spread.sortWithinPartitions("key1", "key2", "second").select("key1", "key2", "second").mapInArrow(_states, STATE)
    order = W.partitionBy("key1", "key2").orderBy("part")
    before = F.last("last", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    stitched = states.withColumn("before", before)
    border = F.when(F.col("first") == F.col("before"), 1).otherwise(0)
    step = F.coalesce(F.col("first") - F.col("before"), F.lit(0))
    return (
        stitched.groupBy("key1", "key2")
        .agg(
            F.sum("n_rows").alias("n_rows"),
            F.sum(F.col("n_distinct") - border).alias("n_distinct"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            F.max(F.greatest("widest", step)).alias("widest"),
        )
        .withColumnRenamed("key1", key1)
        .withColumnRenamed("key2", key2)
    )


def member_counts(cone_entries: DataFrame) -> DataFrame:
    """(checkpoint_id, cluster, n_rows, members, ...) of every cluster with entries."""
    return key_profile(cone_entries, "checkpoint_id", "cluster", "global_id").withColumnRenamed("n_distinct", "members")


def count_mismatches(cone_entries: DataFrame, clusters: DataFrame) -> DataFrame:
    """(checkpoint_id, cluster): clusters whose members differ in number from ``n_c`` or ``cluster_counts``.

    Considers the checkpoints that have entries; a cluster without entries has 0 members.  Repeated and
    contradictory rows of a cluster count as one case if any of them differs; a null count differs from nothing.
    """
    counts = durable(member_counts(cone_entries))  # a row per cluster, used twice
    described = clusters.where(F.col("cluster").isNotNull()).select("checkpoint_id", F.col("cluster").cast("bigint").alias("cluster_"), "n_c", "cluster_counts")
    known = counts.select("checkpoint_id").distinct()
    found = counts.select("checkpoint_id", F.col("cluster").alias("cluster_"), "members")
    compared = described.join(known, "checkpoint_id", "left_semi").join(found, ["checkpoint_id", "cluster_"], "left")
    members = F.coalesce("members", F.lit(0))
    differs = F.coalesce(members != F.col("n_c"), F.lit(False)) | F.coalesce(members != F.col("cluster_counts"), F.lit(False))
    return compared.where(differs).select("checkpoint_id", F.col("cluster_").cast("int").alias("cluster")).distinct()
