"""A mutable collection as files: numbered log segments, versioned snapshots, and the live view of both.

A change is written as a segment under a fresh name and then committed by creating the file of the next free number: writers that meet at a number
both see it taken but one, and the others take the next.  A snapshot is a folder of its own and a manifest created last, so readers see
all of it or nothing.  Only segments after the newest manifest are ever read, so dropping older ones can stop anywhere.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.vecmath import metric_name, usable

SEGMENT = "op string, global_id bigint, vector array<float>"
LOG = f"seq bigint, {SEGMENT}"


class Numbered:
    """JSON files named by numbers, each created once by whoever comes first."""

    def __init__(self, spark: SparkSession, folder: str):
        self._path, self.folder = spark._jvm.org.apache.hadoop.fs.Path, folder
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        at = self._path(self.folder)
        if not self._fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at) if s.getPath().getName().isdigit())

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/{number}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def create(self, number: int, content: dict) -> bool:
        """False if the number is taken."""
        at = self._path(f"{self.folder}/{number}")
        try:
            stream = self._fs.create(at, False)
        except Exception:
            if self._fs.exists(at):
                return False
            raise
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        return True

    def append(self, content: dict, after: int = 0) -> int:
        """Create the file under the next free number above ``after``."""
        number = max([after, *self.numbers()]) + 1
        while not self.create(number, content):
            number += 1
        return number

    def delete(self, number: int) -> None:
        self._fs.delete(self._path(f"{self.folder}/{number}"), False)

    def remove(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)


class Collection:
    """A collection of vectors of ``d`` elements under ``folder``.

    Inserts and updates with an unusable vector are refused; deletes of ids that are unknown or gone change nothing.  Opening a folder whose newest
    snapshot is of another dimension or metric, or holds another number of rows than its manifest says, raises ValueError.
    An id that stands several times in one batch has its greatest vector.
    """

    def __init__(self, spark: SparkSession, folder: str, d: int, metric: str = "l2"):
        self.spark, self.folder, self.d, self.metric = spark, folder.rstrip("/"), d, metric_name(metric)
        self._log, self._manifests = Numbered(spark, f"{self.folder}/log"), Numbered(spark, f"{self.folder}/manifests")
        self.check()

    def check(self) -> None:
        known = self.newest()
        if not known:
            return
        if (known["d"], known["metric"]) != (self.d, self.metric):
            raise ValueError(f"the collection has {known['d']} elements under {known['metric']}, not {self.d} under {self.metric}")
        if (rows := self.spark.read.parquet(known["data"]).count()) != known["rows"]:
            raise ValueError(f"the newest snapshot should hold {known['rows']} rows and holds {rows}")

    # log

    def log(self) -> DataFrame:
        """(seq, op, global_id, vector): the changes after the newest snapshot; ``seq`` numbers the batches."""
        after = self.newest().get("seq", 0)
        out = self.spark.createDataFrame([], LOG)
        segments = [(n, self._log.read(n)["data"]) for n in self._log.numbers() if n > after]
        if segments:
            number = F.create_map(*[F.lit(x) for n, data in segments for x in (data.rsplit("/", 1)[-1], n)])
            name = F.element_at(F.split(F.input_file_name(), "/"), -2)
            rows = self.spark.read.schema(SEGMENT).parquet(*[data for _, data in segments])
            out = out.unionByName(rows.select(number[name].cast("bigint").alias("seq"), "op", "global_id", "vector"))
        return out

    def _append(self, rows: DataFrame) -> int:
        """Commit (op, global_id, vector) as one batch after all known ones; returns its number."""
        data = f"{self.folder}/segments/{uuid.uuid4().hex}"
        rows.select("op", "global_id", F.col("vector").cast("array<float>").alias("vector")).write.parquet(data)
        return self._log.append({"data": data}, self.newest().get("seq", 0))

    def add(self, vectors: DataFrame) -> None:
        """Insert (global_id, vector); known ids are replaced."""
        bad = vectors.where(~usable("vector", self.d) | F.col("global_id").isNull()).limit(1).count()
        if bad:
            raise ValueError(f"vectors must have an id and {self.d} elements, none null or NaN")
        self._append(vectors.select(F.lit("insert").alias("op"), "global_id", "vector"))

    def delete(self, ids: DataFrame, strict: bool = False) -> None:
        """Delete (global_id); with ``strict`` ids that are not live raise IndexError before anything is written."""
        if strict and ids.join(self.live(), "global_id", "left_anti").limit(1).count():
            raise IndexError("some ids are not in the collection")
        self._append(ids.select(F.lit("delete").alias("op"), "global_id", F.lit(None).cast("array<float>").alias("vector")))

    def update(self, vectors: DataFrame) -> None:
        self.add(vectors)

    # snapshots

    def newest(self) -> dict:
        numbers = self._manifests.numbers()
        return self._manifests.read(numbers[-1]) if numbers else {}

    def states(self, upto: int | None = None) -> DataFrame:
        """(global_id, state): the newest snapshot with the log's later changes (to batch ``upto``) folded in; tombstones are kept."""
        manifest = self.newest()
        log = self.log() if upto is None else self.log().where(F.col("seq") <= upto)
        changes = log.select("global_id", F.struct("seq", "op", F.when(F.col("op") != "delete", F.col("vector")).alias("vector")).alias("state"))
        if manifest:
            changes = changes.unionByName(self.spark.read.parquet(manifest["data"]))
        return changes.groupBy("global_id").agg(F.max("state").alias("state"))

    def live(self) -> DataFrame:
        """(global_id, vector) of what is not deleted."""
        return self.states().where("state.op <> 'delete'").select("global_id", "state.vector")

    def snapshot(self) -> int:
        """Write a snapshot of all states, deletes included, and make it the newest; returns its number."""
        top = max([self.newest().get("seq", 0), *self._log.numbers()])
        data = f"{self.folder}/snapshots/{uuid.uuid4().hex}"
        self.states(top).write.parquet(data)
        rows = self.spark.read.parquet(data).count()
        return self._manifests.append({"data": data, "seq": top, "rows": rows, "d": self.d, "metric": self.metric})

    def truncate_log(self) -> None:
        """Drop the segments that the newest snapshot holds; nobody reads them any more."""
        seq = self.newest().get("seq", 0)
        for number in self._log.numbers():
            if number <= seq:
                data = self._log.read(number)["data"]
                self._log.delete(number)
                self._log.remove(data)

    def describe(self) -> dict:
        counts = self.states().agg(F.count_if(F.col("state.op") != "delete").alias("n"), F.count_if(F.col("state.op") == "delete").alias("n_deleted")).first()
        return {"n": counts["n"], "n_deleted": counts["n_deleted"], "d": self.d, "metric": self.metric, "snapshots": len(self._manifests.numbers())}
