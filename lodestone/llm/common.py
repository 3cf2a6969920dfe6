"""What the operators share: work tables in the cluster's shared folder and joins of checked size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its counted rows are at most this many.
BROADCAST_ROWS = 400_000
#: Bytes of an Arrow batch between Spark and Python, so that long texts don't fill a worker's memory.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one in local mode, in
    which all tasks share a machine; elsewhere an error, as executors couldn't see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/lodestone-work"
    return f"{base.rstrip('/')}/lodestone"


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs the tasks it ran, not the stages before. The
    shuffle files of the writing query are removed as it ends.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spool_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete spooled tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(df._spool_path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def join_spooled(left: DataFrame, right: DataFrame, on: Sequence[str] | str, how: str = "left", rows: int | None = None) -> DataFrame:
    """Join with a spooled ``right``: broadcast when its counted rows are few, else by shuffles
    of both sides, whose hot keys adaptive execution splits."""
    n = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if n <= BROADCAST_ROWS else right, on, how)


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns of ``df`` cast to the given types, whatever else it holds, in batches of
    bounded bytes."""
    bounded_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in kinds.items()])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
