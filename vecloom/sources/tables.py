"""Table access and the small pieces of session handling every operator shares."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship_code(spark: SparkSession) -> None:
    """Give the workers this package, once per context: they need not have it on their path."""
    context, package = spark.sparkContext, Path(__file__).resolve().parent.parent
    if getattr(context, "_vecloom_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="vecloom-code-")) / "vecloom.zip"  # read by the driver, which serves it to the executors
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._vecloom_shipped = True


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Only a session on one machine may lack it, as in tests: it then gets a folder of its own.  A cluster without it raises RuntimeError.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="vecloom-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder there."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder.  The files are reliable: a lost executor does not lose them."""
    root = shared_root(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


def slices(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the parallelism operators size their exchanges by."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_enough(df: DataFrame, row_bytes: int, limit: int) -> bool:
    """True if ``df`` holds at most ``limit`` bytes, at ``row_bytes`` a row: the gate before any broadcast.

    The count stops at the limit, so the gate itself is cheap on tables of any size.
    """
    most = max(1, limit // row_bytes)
    return df.limit(most + 1).count() <= most


def last_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """(index_id, checkpoint_id, taken_ns): the finished attempt with the greatest timestamp of each index.

    Repeated rows count once; failed attempts (null ``finished``) never count; ties go to the greater id.
    """
    best = F.max(F.struct("timestamp_ns", "checkpoint_id")).alias("best")
    return (
        checkpoints.where(F.col("finished").isNotNull() & F.col("timestamp_ns").isNotNull() & F.col("index_id").isNotNull())
        .groupBy("index_id")
        .agg(best)
        .select("index_id", F.col("best.checkpoint_id").alias("checkpoint_id"), F.col("best.timestamp_ns").alias("taken_ns"))
    )
