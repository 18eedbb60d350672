"""Shared helpers: table access, word patterns, and the shared folder."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a run of characters that are none of space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a shuffle partition and of an Arrow batch.
SPLIT, BATCH = 256 << 20, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master (as in tests) gets a temporary folder of this machine; on
    a cluster that is an error, as executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="runloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    """Hadoop's path, and the file system that it lies in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder. What the application left there goes when it ends."""
    top = f"{shared_dir(spark)}/runloom-{spark.sparkContext.applicationId}"
    p, fs = _hadoop(spark, top)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that nothing reads any more."""
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions(table: DataFrame) -> int:
    """How many partitions a stored table needs when it is dealt out: SPLIT bytes each, and the session's number at least.

    Only for tables as they are read: the optimizer's sizes of joins and checkpoints are no measure.
    """
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(shuffle_partitions(table.sparkSession), -(-size // SPLIT) if size < 1 << 55 else 0)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH bytes at most, so that long texts don't fill an executor's memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH:
        spark.conf.set(name, str(BATCH))


def release() -> None:
    """Give free memory of a Python worker back, as it lives on and idles beside later stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def words(text: Column) -> Column:
    """The words of a text, in order; none where it is null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file; the files are never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)
