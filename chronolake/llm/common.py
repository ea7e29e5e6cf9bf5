"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_C = ctypes.CDLL(None)  # the C library that is loaded already


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set (tests on one machine)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"{tempfile.gettempdir()}/chronolake-checkpoints"
    return at


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: later steps neither recompute it nor depend on one executor.

    The shuffle files behind it aren't needed any more; collecting garbage lets Spark's cleaner remove them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    tidy(spark)
    return out


def tidy(spark: SparkSession) -> None:
    """Let go of what the driver no longer needs: Python objects, memory that the C library keeps for later, frames behind written tables."""
    gc.collect()
    trim = getattr(_C, "malloc_trim", None)
    if trim is not None:
        trim(0)
    spark.sparkContext._jvm.System.gc()


def discard(*frames: DataFrame) -> None:
    """Delete what `stored` wrote for frames that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, k: int) -> Column:
    """crc32 of the id's decimal text modulo k; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(k))


def cut_parts(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
