"""Ingest of arriving documents: each micro-batch goes through the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest import ingest
from ..plans.store import Store
from .versions import DAY, newest_versions, with_state_store


def not_older(rows: DataFrame, store: Store) -> DataFrame:
    """Documents that are no older than what the store has of their page."""
    states = store.table("page_states")
    if states is None:
        return rows
    known = states.select("page_id", F.col("page_version").alias("_stored"))
    return rows.join(known, "page_id", "left").filter(F.col("_stored").isNull() | (F.col("version") >= F.col("_stored"))).drop("_stored")


def ingest_stream(store: Store, docs: DataFrame, checkpoint: str, once: bool = True, ttl_ms: int = 7 * DAY, **options) -> StreamingQuery:
    """docs: a streaming frame of documents, whose versions may come late, out of order and more than once.

    State by page lets each page's versions only rise; what comes after a page's state was forgotten is held against the store. A batch
    that is run again changes nothing: the manifest knows its number.
    """

    def batch(rows: DataFrame, number: int) -> None:
        now = Store(rows.sparkSession, store.folder, store.buckets, store.embedder)
        ingest(now, not_older(rows, now), batch=(checkpoint, number), **options)

    w = newest_versions(docs, ttl_ms).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    with with_state_store(docs.sparkSession):
        return (w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")).start()
