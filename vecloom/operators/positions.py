"""Running sums over sorted groups of any size.

All rows are range-partitioned by (group, value, tie-breakers) at sampled quantiles, so a group with a third of all rows, or one value
repeated endlessly, is cut into as many ranges as its share asks for.  A partition sums as its sorted rows stream past; what stands before
it in a group is added from one row per group and partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.sources.tables import durable, ship_code, slices, small_enough

#: Bytes up to which the sums of whole partitions (a row per group and partition) are broadcast.
SUMS_LIMIT = 4 * 2**20


def _streamed(by: list[int], weight: int, names: list[str]):
    """Rows as they come, with the partition's number and the sum of ``weight`` over the group's rows before them in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, reached = TaskContext.get().partitionId(), None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            w = b.column(weight).cast(pa.int64()).to_numpy(zero_copy_only=False)
            fresh = np.zeros(n, bool)
            for i in by:
                c = b.column(i)
                fresh[1:] |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
            first = tuple(b.column(i)[0].as_py() for i in by)
            fresh[0] = True
            starts = np.flatnonzero(fresh)
            before = np.cumsum(w) - w
            base = before[starts] - np.where(starts == 0, reached if first == last else 0, 0)
            inside = before - np.repeat(base, np.diff(np.r_[starts, n]))
            last, reached = tuple(b.column(i)[n - 1].as_py() for i in by), int(inside[-1] + w[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(inside, pa.int64())], names=names)

    return run


def running(df: DataFrame, by: list[str], value: str, then: list[str], weight: str, name: str, ranges: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``weight`` (whole numbers) over the rows before each row, per ``by``, ordered by ``value`` and ``then``.

    Rows of one order key stand in any order.  ``by`` must not be null.  The result lies in the shared folder, sorted within its partitions.
    """
    ship_code(df.sparkSession)
    keys = [*by, value, *then]
    spread = df.repartitionByRange(ranges or slices(df.sparkSession), *keys).sortWithinPartitions(*keys)
    at = {c: i for i, c in enumerate(df.columns)}
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    run = _streamed([at[c] for c in by], at[weight], [*df.columns, "_part", "_inside"])
    cut = durable(spread.mapInArrow(run, f"{fields}, _part int, _inside bigint"))
    sums = cut.groupBy(*by, "_part").agg(F.sum(weight).cast("bigint").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    table = sums.select(*by, "_part", before.alias("_before"))
    joined = cut.join(F.broadcast(table) if small_enough(table, 64, SUMS_LIMIT) else table, [*by, "_part"])
    return joined.withColumn(name, F.col("_before") + F.col("_inside")).select(*df.columns, name)
