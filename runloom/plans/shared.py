"""Tables that a plan writes once and reads several times, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where it is unset, for local masters only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="runloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path, which goes when the application ends."""
    top = f"{shared_folder(spark)}/plans-{spark.sparkContext.applicationId}"
    p = spark._jvm.org.apache.hadoop.fs.Path(top)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str, *order: str) -> DataFrame:
    """The rows, written once; sorted inside files, so that filters on ``order`` skip row groups."""
    path = new_path(df.sparkSession, name)
    (df.sortWithinPartitions(*order) if order else df).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Dealt out anew where a table has fewer splits than there are cores, as before costly work on each row."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
