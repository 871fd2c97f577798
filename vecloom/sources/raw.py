"""Flat files of 32-bit floats, and result logs as JSON lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators.coarse import lists
from vecloom.sources.tables import ship_code, slices


def read_floats(spark: SparkSession, path: str, d: int) -> DataFrame:
    """(id, vec): rows of ``d`` little-endian floats, numbered by their place in the file.

    The file is split at record borders, so one of any size is read in parallel; a last incomplete record is an error.
    """
    records = spark.sparkContext.binaryRecords(path, 4 * d).zipWithIndex()
    return records.map(lambda r: (r[1], np.frombuffer(r[0], "<f4").tolist())).toDF("id bigint, vec array<float>")


def append_results(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines, one file per task."""
    rows.write.mode("append").json(path)


def gaussian(spark: SparkSession, n: int, d: int, seed: int = 42) -> DataFrame:
    """(id, vec): ``n`` vectors of independent standard normal elements; a row depends on seed and id only."""
    draws = [F.randn(seed + i).cast("float") for i in range(d)]
    return spark.range(0, n, 1, max(1, n // 65_536)).select("id", F.array(*draws).alias("vec"))


def chunked(spark: SparkSession, source: Callable[[int, int], np.ndarray], n: int, d: int, chunk: int = 4_096) -> DataFrame:
    """(id, vec): rows 0 to ``n`` of ``source(start, end)``, asked for in chunks, each where it is used.

    ``source`` gives a matrix of ``end - start`` rows of ``d`` elements; anything else raises ValueError.
    """
    ship_code(spark)
    starts = spark.range(0, n, chunk, max(1, min(-(-n // chunk), 4 * slices(spark))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in b.column(0).to_pylist():
                end = min(start + chunk, n)
                x = np.asarray(source(start, end), np.float32)
                if x.shape != (end - start, d):
                    raise ValueError(f"rows {start} to {end} came as {x.shape}")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, end)), lists(x)], names=["id", "vec"])

    return starts.mapInArrow(run, "id bigint, vec array<float>")
