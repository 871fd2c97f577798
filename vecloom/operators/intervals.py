"""Processing only what is new: a ledger of processed sequence numbers as disjoint intervals.

A ledger row (key, lo, hi) says that every number of ``key`` present between lo and hi was processed.
A run subtracts the ledger from what is available, processes the gaps — late commits fall into gaps
like new rows do — and commits its output together with the merged ledger.  Every step works on
blocks of ``BLOCK`` sequence numbers, so a key with a third of all rows, or of all intervals, is spread over many tasks; what
one block has to know of those before it comes from a table with one row per key and block.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.sources.tables import durable

#: Sequence numbers in one block; bounds the rows of a window partition.
BLOCK = 65_536


def _block(c: str) -> F.Column:
    return F.floor(F.col(c) / BLOCK).cast("bigint")


def _carried(rows: DataFrame, key: str, value: F.Column, how, name: str) -> DataFrame:
    """``rows`` (with ``_block``) and ``name``: ``how`` of ``value`` over all earlier blocks of the key; null in the first block.

    Aggregated per block first (partially before the shuffle), then over one row per block.  ``rows`` are computed twice: callers keep
    what they come from in the shared folder.
    """
    tops = rows.groupBy(key, "_block").agg(how(value).alias("_top"))
    before = how("_top").over(W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    return rows.join(tops.select(key, "_block", before.alias(name)), [key, "_block"])


def _runs(rows: DataFrame, key: str) -> DataFrame:
    """(key, _start, lo, hi, ...) of rows (key, _block, lo, hi, _opens): each row with the ``lo`` of the last row that opens a run."""
    inner = W.partitionBy(key, "_block").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, 0)
    opened = F.when(F.col("_opens"), F.col("lo"))
    known = _carried(rows, key, opened, F.max, "_earlier")
    return known.withColumn("_start", F.coalesce(F.max(opened).over(inner), F.col("_earlier")))


def merge(intervals: DataFrame, key: str = "key") -> DataFrame:
    """The disjoint, sorted union of (key, lo, hi); intervals that overlap or touch (hi + 1 = lo) join.

    Null keys, null bounds and empty intervals (hi < lo) are dropped.  An interval lies in the block it begins in, however far it reaches.
    """
    sound = intervals.select(key, "lo", "hi").where(F.col(key).isNotNull() & F.col("lo").isNotNull() & (F.col("hi") >= F.col("lo")))
    placed = _carried(durable(sound.withColumn("_block", _block("lo"))), key, F.col("hi"), F.max, "_reached")
    inner = W.partitionBy(key, "_block").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)
    reach = F.greatest(F.max("hi").over(inner), F.col("_reached"))  # nulls don't count
    opens = placed.select(key, "_block", "lo", "hi", F.coalesce(F.col("lo") > reach + 1, F.lit(True)).alias("_opens"))
    return _runs(opens, key).groupBy(key, "_start").agg(F.max("hi").alias("hi")).select(key, F.col("_start").alias("lo"), "hi")


def islands(rows: DataFrame, flag: str, key: str = "key", seq: str = "seq") -> DataFrame:
    """(key, lo, hi) of the maximal runs of flagged rows, neighbours being rows next to each other in ``seq``.

    Numbers that a key doesn't have (they belong to other keys) don't break a run.  Rows without key or number are in no run.  Runs are
    found within blocks, and stitched where the last row of the block before is flagged alike.
    """
    base = rows.select(F.col(key), F.col(seq).alias("_seq"), F.col(flag).cast("int").alias("_flag")).where(F.col(seq).isNotNull() & F.col(key).isNotNull())
    base = base.withColumn("_block", _block("_seq"))
    inner = W.partitionBy(key, "_block").orderBy("_seq")
    changed = F.when(F.lag("_flag").over(inner) == F.col("_flag"), 0).otherwise(1)
    runs = base.withColumn("_new", changed).withColumn("_run", F.sum("_new").over(inner.rowsBetween(W.unboundedPreceding, 0)))
    local = durable(runs.groupBy(key, "_block", "_run", "_flag").agg(F.min("_seq").alias("lo"), F.max("_seq").alias("hi")))
    last = F.struct("lo", "_flag")  # of the latest run in the blocks before
    known = _carried(local, key, last, F.max, "_before")
    follows = (F.col("_run") == 1) & (F.col("_before._flag") == F.col("_flag"))
    opens = known.where("_flag = 1").select(key, "_block", "lo", "hi", (~F.coalesce(follows, F.lit(False))).alias("_opens"))
    return _runs(opens, key).groupBy(key, "_start").agg(F.max("hi").alias("hi")).select(key, F.col("_start").alias("lo"), "hi")


def subtract(available: DataFrame, done: DataFrame, key: str = "key", disjoint: bool = False) -> DataFrame:
    """(key, lo, hi): the parts of ``available`` that ``done`` doesn't cover, none touching another.

    Both are merged first, unless they are known to be ``disjoint`` and without touching neighbours, as ``merge`` and ``islands`` give them.
    """

    def edges(df: DataFrame, a: int, b: int) -> DataFrame:
        ends = [F.struct(at.alias("at"), F.lit(a * sign).alias("a"), F.lit(b * sign).alias("b")) for at, sign in ((F.col("lo"), 1), (F.col("hi") + 1, -1))]
        return (df if disjoint else merge(df, key)).select(key, F.explode(F.array(*ends)).alias("e")).select(key, "e.*")

    points = edges(available, 1, 0).unionByName(edges(done, 0, 1)).groupBy(key, "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    points = durable(points.where("a <> 0 or b <> 0").withColumn("_block", _block("at")))
    # per block what is open before it, and where the next block's first edge lies
    sums = points.groupBy(key, "_block").agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"), F.min("at").alias("_at"))
    every = W.partitionBy(key).orderBy("_block")
    before = every.rowsBetween(W.unboundedPreceding, -1)
    table = sums.select(key, "_block", F.coalesce(F.sum("_a").over(before), F.lit(0)).alias("_a"), F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b"), F.lead("_at").over(every).alias("_next"))
    order = W.partitionBy(key, "_block").orderBy("at")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    swept = points.join(table, [key, "_block"]).select(
        key, F.col("at").alias("lo"), (F.coalesce(F.lead("at").over(order), F.col("_next")) - 1).alias("hi"),
        (F.sum("a").over(upto) + F.col("_a")).alias("open"), (F.sum("b").over(upto) + F.col("_b")).alias("shut"),
    )
    # every edge changes what is open or shut, so no two gaps touch
    return swept.where("open > 0 and shut = 0 and hi is not null").select(key, "lo", "hi")


def flag_inside(rows: DataFrame, intervals: DataFrame, name: str, key: str = "key", seq: str = "seq") -> DataFrame:
    """``rows`` with a boolean ``name``: whether ``seq`` lies in one of the disjoint ``intervals`` of its key.

    An interval is cut at block borders; within a block the last interval start at or before a row
    decides, found by one sorted pass over rows and starts together: no range join, no broadcast.
    A null ``seq`` is in no interval.
    """
    cut = intervals.select(key, "lo", "hi", F.explode(F.sequence(_block("lo"), _block("hi"))).alias("_block")).select(
        F.col(key), "_block", F.greatest("lo", F.col("_block") * BLOCK).alias("_at"), F.col("hi").alias("_hi"), F.lit(0).alias("_side"), F.lit(None).cast(rows.select(F.struct(*rows.columns).alias("r")).schema["r"].dataType).alias("_row")
    )
    tagged = rows.select(F.col(key), _block(seq).alias("_block"), F.col(seq).cast("bigint").alias("_at"), F.lit(None).cast("bigint").alias("_hi"), F.lit(1).alias("_side"), F.struct(*rows.columns).alias("_row"))
    order = W.partitionBy(key, "_block").orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
    reach = F.last("_hi", ignorenulls=True).over(order)
    flagged = cut.unionByName(tagged).withColumn(name, F.coalesce(F.col("_at") <= reach, F.lit(False)))
    return flagged.where("_side = 1").select("_row.*", name)


class Ledger:
    """A versioned folder of processed intervals and the outputs committed with them.

    A run writes its output and its new ledger under fresh names and then creates one manifest file;
    only what a manifest names exists for later runs.  A run that dies before leaves nothing visible,
    a run repeated after a lost acknowledgement finds its rows in the ledger already.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "key", seq: str = "seq"):
        self.spark, self.folder, self.key, self.seq = spark, folder.rstrip("/"), key, seq
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        at = self._fs_path(f"{self.folder}/manifests")
        if not self._fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at) if s.getPath().getName().isdigit())

    def _manifest(self, n: int) -> dict:
        stream = self._fs.open(self._fs_path(f"{self.folder}/manifests/{n}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def processed(self) -> DataFrame:
        known = self._manifests()
        if not known:
            return self.spark.createDataFrame([], f"{self.key} bigint, lo bigint, hi bigint")
        return self.spark.read.parquet(self._manifest(known[-1])["ledger"])

    def outputs(self) -> list[str]:
        return [p for n in self._manifests() if (p := self._manifest(n)["output"])]

    def pending(self, source: DataFrame) -> DataFrame:
        """The rows of ``source`` whose number the ledger lacks.  Rows without key or number never pend."""
        sound = source.where(F.col(self.key).isNotNull() & F.col(self.seq).isNotNull())
        return flag_inside(sound, self.processed(), "_vecloom_done", self.key, self.seq).where("not _vecloom_done").drop("_vecloom_done")

    def run(self, source: DataFrame, process, before_commit=None) -> int:
        """Process the pending rows with ``process(DataFrame) -> DataFrame``; returns the manifest's number.

        ``before_commit`` is called after the output is written, for tests of failures at that point.
        """
        known, token = self._manifests(), uuid.uuid4().hex
        staged, output, ledger = (f"{self.folder}/{what}/{token}" for what in ("staged", "output", "ledger"))
        # staged once: output and ledger must speak of the same rows, however often a task is retried
        self.pending(source).write.parquet(staged)
        batch = self.spark.read.parquet(staged)
        process(batch).write.parquet(output)
        taken = batch.select(F.col(self.key), F.col(self.seq).alias("lo"), F.col(self.seq).alias("hi"))
        merge(self.processed().unionByName(taken), self.key).write.parquet(ledger)
        if before_commit:
            before_commit()
        number = (known[-1] if known else 0) + 1
        at = self._fs_path(f"{self.folder}/manifests/{number}")
        stream = self._fs.create(at, False)  # fails if another run committed this number meanwhile
        stream.write(bytearray(json.dumps({"output": output, "ledger": ledger}).encode()))
        stream.close()
        self._fs.delete(self._fs_path(staged), True)
        return number
