"""A change feed as a stream: micro-batches of distinct changes, folded to states on reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecloom.operators import fold


def fold_stream(stream: DataFrame, folder: str) -> None:
    """Take in all that ``stream`` (a feed) has now: the distinct changes of each micro-batch, under the batch's number.

    A batch that is run again overwrites its own changes, so each counts once.  Deliveries of one change may come in several
    batches; which is the first is settled when the states are read.
    """

    def put(batch: DataFrame, number: int) -> None:
        lean = batch.select("global_id", "index_id", "op", "timestamp_ns", "vector", "seq")
        fold.changes(lean).withColumnRenamed("kind", "op").write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()


def states(spark: SparkSession, folder: str, d: int = 32) -> DataFrame:
    """(global_id, kind, timestamp_ns, seq, vector): the folded state of everything streamed so far, tombstones included."""
    kept = spark.read.parquet(f"{folder}/changes").drop("batch")
    return fold.fold(fold.states_of_changes(kept, d)).select("global_id", "state.kind", "state.timestamp_ns", "state.seq", "state.vector")
