"""Applying a change feed: a commutative fold of the greatest change per key.

The state of a key is one struct (timestamp, sequence, operation, payload).  Taking the maximum is
associative, commutative and idempotent, so deliveries may be repeated, late or out of order, partial
results combine before the shuffle, and folding a state with further changes gives what folding
everything at once gives.  Deletes stay in the state as tombstones, so a change that arrives after
the delete but was made before it stays undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.functions.vecmath import usable

#: Spellings of each operation, after trimming and lower-casing (fixed values; 1, 2 and 3 are the log's codes).
OPERATIONS = {"insert": ("i", "insert", "1"), "delete": ("d", "delete", "2"), "update": ("u", "update", "3")}

#: Base rows stand before every change of the feed.
BEFORE_ALL = -(2**63)


def meaning(op: Column) -> Column:
    """insert, delete or update; null for heartbeats and anything unknown."""
    word = F.lower(F.trim(op))
    out = F.lit(None).cast("string")
    for name, spellings in OPERATIONS.items():
        out = F.when(word.isin(*spellings), F.lit(name)).otherwise(out)
    return out


def changes(feed: DataFrame) -> DataFrame:
    """One row per change: (global_id, index_id, kind, timestamp_ns, vector, seq), at its smallest ``seq``.

    Deliveries alike in id, meaning, time and vector (nulls equal each other) are one change.  Rows without
    an id or a known meaning are no changes.  Extra columns are ignored; an empty feed gives no rows.
    Partial aggregation collapses repeats before the shuffle, and the shuffle key holds the whole change,
    so an id that changes very often is spread over all tasks.
    """
    rows = feed.select("global_id", "index_id", meaning(F.col("op")).alias("kind"), "timestamp_ns", "vector", "seq")
    return (
        rows.where(F.col("global_id").isNotNull() & F.col("kind").isNotNull())
        .groupBy("global_id", "kind", "timestamp_ns", "vector")
        .agg(F.min("seq").alias("seq"), F.min("index_id").alias("index_id"))
        .select("global_id", "index_id", "kind", "timestamp_ns", "vector", "seq")
    )


def _state(kind: Column, vector: Column) -> Column:
    return F.struct(
        F.coalesce(F.col("timestamp_ns"), F.lit(BEFORE_ALL + 1)).alias("timestamp_ns"),
        F.coalesce(F.col("seq"), F.lit(-1).cast("bigint")).alias("seq"),
        kind.alias("kind"),
        F.when(kind != "delete", vector).alias("vector"),
    )


def states_of_changes(feed: DataFrame, d: int = 32) -> DataFrame:
    """(global_id, state) for every effective change: deletes, and inserts or updates with a usable vector."""
    kind = F.col("kind")
    effective = (kind == "delete") | usable("vector", d)
    return changes(feed).where(effective).select("global_id", _state(kind, F.col("vector")).alias("state"))


def states_of_base(base: DataFrame, d: int = 32) -> DataFrame:
    """(global_id, state) of the rows as loaded, which lie before any change; unusable vectors give none."""
    return base.where(F.col("global_id").isNotNull() & usable("vector", d)).select(
        "global_id",
        F.struct(
            F.lit(BEFORE_ALL).alias("timestamp_ns"),
            F.coalesce(F.unix_micros("added"), F.lit(-1)).cast("bigint").alias("seq"),
            F.lit("base").alias("kind"),
            F.col("vector").alias("vector"),
        ).alias("state"),
    )


def fold(*states: DataFrame) -> DataFrame:
    """(global_id, state): the greatest state of each key over any number of state tables, tombstones kept."""
    union = states[0]
    for other in states[1:]:
        union = union.unionByName(other)
    return union.groupBy("global_id").agg(F.max("state").alias("state"))


def apply_feed(base: DataFrame, feed: DataFrame, d: int = 32) -> DataFrame:
    """The folded state of every id of ``base`` and ``feed``: (global_id, kind, timestamp_ns, seq, vector).

    ``kind`` is base, insert, update or delete; a delete row is a tombstone with a null vector.
    """
    return fold(states_of_base(base, d), states_of_changes(feed, d)).select("global_id", "state.kind", "state.timestamp_ns", "state.seq", "state.vector")


def current(folded: DataFrame) -> DataFrame:
    """The live rows of a folded state: (global_id, vector)."""
    return folded.where(F.col("kind") != "delete").select("global_id", "vector")
