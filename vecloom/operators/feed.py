"""Which changes of a feed a checkpoint does not hold yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators.fold import meaning
from vecloom.operators.intervals import flag_inside, islands, subtract
from vecloom.sources.tables import last_checkpoints


def deliveries(feed: DataFrame) -> DataFrame:
    """(index_id, seq, arrived, change): every delivery of a change, the change as a 128-bit digest and its plain parts.

    The vector stands in as two independent 64-bit hashes, so a shuffle moves 16 bytes instead of the array.
    """
    rows = feed.select("index_id", "seq", "arrived", "global_id", meaning(F.col("op")).alias("kind"), "timestamp_ns", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit("second"), "vector").alias("h2"), F.col("vector").isNull().alias("none"))
    return rows.where(F.col("global_id").isNotNull() & F.col("kind").isNotNull() & F.col("seq").isNotNull())


def held_intervals(feed: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(index_id, lo, hi): the ledger that the last complete checkpoints amount to.

    A checkpoint holds a delivery if it had arrived by its time; a delivery without an arrival time is not held.
    Failed attempts hold nothing.  The join is with one row per index, and left, so indexes without a
    complete checkpoint keep all their deliveries as new.
    """
    taken = last_checkpoints(checkpoints).select("index_id", "taken_ns")
    marked = feed.select("index_id", "seq", "arrived").join(taken, "index_id", "left")
    marked = marked.withColumn("held", F.coalesce(F.unix_micros("arrived") * 1000 <= F.col("taken_ns"), F.lit(False)))
    return islands(marked, "held", "index_id")


def available_intervals(feed: DataFrame) -> DataFrame:
    """(index_id, lo, hi): the span of sequence numbers each index has."""
    return feed.where("seq is not null and index_id is not null").groupBy("index_id").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))


def gaps(feed: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(index_id, lo, hi): the intervals a run has to process."""
    return subtract(available_intervals(feed), held_intervals(feed, checkpoints), "index_id", disjoint=True)


def new_changes(feed: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(seq): the smallest number of every change none of whose deliveries the last complete checkpoint holds.

    No checkpoint holds a delivery without an index.
    """
    rows = flag_inside(deliveries(feed), gaps(feed, checkpoints), "fresh", "index_id").withColumn("fresh", F.col("fresh") | F.col("index_id").isNull())
    return (
        rows.groupBy("global_id", "kind", "timestamp_ns", "h1", "h2", "none")
        .agg(F.min("seq").alias("seq"), F.min("fresh").alias("fresh"))
        .where("fresh")
        .select("seq")
    )
