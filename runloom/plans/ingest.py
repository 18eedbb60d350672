"""Incremental ingest: only new and changed pages are chunked, embedded and indexed."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import strip
from ..operators.chunking import chunk_documents
from .log import Log
from .progress import Progress
from .store import Store


def last_of_each(docs: DataFrame) -> DataFrame:
    """One row a page: the highest version, then the greatest hash."""
    order = Window.partitionBy("page_id").orderBy(F.desc("version"), F.desc("content_hash"))
    return docs.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def changes(docs: DataFrame, states: DataFrame | None, force: bool = False) -> DataFrame:
    """The documents with ``action``: ingest, unchanged, blank, or failed (those with an ``error`` of their source)."""
    blank = F.coalesce(strip(F.col("markdown")) == "", F.lit(True))
    if states is None:
        same = F.lit(False)
    else:
        s = states.select("page_id", F.col("page_version").alias("_v"), F.col("content_hash").alias("_h"))
        docs = docs.join(s, "page_id", "left")
        same = F.col("version").eqNullSafe(F.col("_v")) & F.col("content_hash").eqNullSafe(F.col("_h"))
    broken = F.col("error").isNotNull() if "error" in docs.columns else F.lit(False)
    action = F.when(broken, "failed").when(blank, "blank").when(same & ~F.lit(force), "unchanged").otherwise("ingest")
    return docs.withColumn("action", action).drop("_v", "_h")


def ingest(store: Store, docs: DataFrame, force: bool = False, prune_missing: bool = False, most: int = 512, least: int = 96, overlap: int = 64, limit: int | None = None, batch: tuple[str, int] | None = None, log: Log | None = None, resume: bool = True, progress: Progress | None = None) -> DataFrame:
    """Bring the store up to date; returns a report of one row. Where no page changed, the store stays as it is.

    Only the pages that changed are written. ``batch``: a stream's name and batch number. ``log``: with ``resume``, what the log has of a page
    settles whether it changed, without a look at the store; else the log is cleared and the store settles it. Pages of the commit are appended.
    ``progress`` reports while pages are chunked.
    """
    states = store.table("page_states")
    if log is not None and resume:
        log.catch_up(store)
        states = log.states() if log.exists() else states
    elif log is not None:
        log.clear()
        log.catch_up(store)
    with store.staging() as stage:
        # Which documents a limit takes, and what the chunker made of them, is settled once. Texts of other pages are not written.
        todo = changes(last_of_each(docs if limit is None else docs.limit(limit)), states, force)
        todo = stage("todo", todo.withColumn("markdown", F.when(F.col("action") == "ingest", F.col("markdown"))))
        fresh = todo.filter("action = 'ingest'").drop("error")
        with progress.over(fresh.count()) if progress is not None else contextlib.nullcontext():
            made = stage("made", chunk_documents(fresh, most, least, overlap, done=progress.done if progress is not None else None))
        good, failed = made.filter("error is null").drop("error"), made.filter("error is not null")
        report = todo.agg(
            F.count(F.lit(1)).alias("seen"), F.count_if(F.col("action") == "ingest").alias("changed"), F.count_if(~F.col("action").isin("ingest", "failed")).alias("skipped")
        ).join(failed.select("page_id").unionByName(todo.filter("action = 'failed'").select("page_id")).agg(F.count_distinct("page_id").alias("failed")), how="cross").join(good.agg(F.count(F.lit(1)).alias("chunks")), how="cross")
        row = report.collect()
        # Pages that failed keep what they had.
        touched = fresh.select("page_id").join(failed.select("page_id"), "page_id", "left_anti")
        gone = 0
        if prune_missing and states is not None:
            missing = stage("missing", states.select("page_id").join(todo.select("page_id"), "page_id", "left_anti"))
            gone, touched = missing.count(), touched.unionByName(missing)
        if states is None or row[0]["changed"] or gone:
            store.commit(good, touched, batch)
            if log is not None:
                log.catch_up(store)
    return store.spark.createDataFrame(row, report.schema)
