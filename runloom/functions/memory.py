"""Bounds on the memory of Python workers: bytes of a batch, and what a task leaves behind."""

from __future__ import annotations

import contextlib

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch, and rows that a task puts together before it hands them on.
BATCH, ROWS = 8 << 20, 50_000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH bytes at most, whatever the length of texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH:
        spark.conf.set(name, str(BATCH))


def release() -> None:
    """Give free memory back, as a worker lives on and idles beside those of later stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)
