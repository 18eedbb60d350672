"""The versions of each page in a stream of documents, in order: late and repeated ones are left out.

State by page: the version and hash that went out last. It is forgotten a while after the page was last seen, so that state
is bounded by the pages of that time; what comes later than that is held against the store (see ``ingest_stream``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What such a query starts with. State is only forgotten with a batch that has rows: batches without any would never end.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
DAY = 24 * 3600 * 1000


class Newest(StatefulProcessor):
    """Of each page's rows in a batch the one of the greatest version, then hash, if that is beyond what went out."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "version long, hash string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        # (version, hash); a null version is the least.
        order = lambda r: (-1 if pd.isna(r["version"]) else int(r["version"]), r["content_hash"] or "")
        best, row = tuple(self.last.get()) if self.last.exists() else None, None
        for part in rows:
            for i in range(len(part)):
                one = part.iloc[[i]]
                if best is None or order(one.iloc[0]) > best:
                    best, row = order(one.iloc[0]), one
        if row is not None:
            self.last.update(best)
            yield row

    def close(self) -> None:
        pass


def newest_versions(docs: DataFrame, ttl_ms: int = 7 * DAY) -> DataFrame:
    """docs: a streaming frame with page_id, version and content_hash -> the same columns, each page's versions rising.

    The query has to run with the state store of ``PROVIDER`` (``with_state_store``).
    """
    return docs.filter("page_id is not null").groupBy("page_id").transformWithStateInPandas(Newest(ttl_ms), docs.schema, "Append", "ProcessingTime")


class with_state_store:
    """Queries that start inside have SETTINGS; the session's are put back at the end."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self) -> None:
        self.before = {k: self.spark.conf.get(k) for k in SETTINGS}
        for k, v in SETTINGS.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_) -> None:
        for k, v in self.before.items():
            self.spark.conf.set(k, v)
