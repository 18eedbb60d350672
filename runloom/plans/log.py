"""The checkpoint log: a JSON line for each page of each commit, appended after the commit.

A line is whole or not there for the reader: torn ones, as a killed writer leaves them, are skipped. The last line of a page wins, by
its commit's number and then by its place. A page that was deleted has a line with an empty hash. If a job died after its commit
and before its lines, ``catch_up`` writes them from the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .store import Store

LINE = "page_id string, version long, hash string, chunks long, commit long"


class Log:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _hadoop(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        p, fs = self._hadoop()
        return fs.exists(p) and any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(p))

    def lines(self) -> DataFrame:
        """All whole lines."""
        if not self.exists():
            return self.spark.createDataFrame([], LINE)
        rows = self.spark.read.text(self.folder).select(F.from_json("value", LINE).alias("r"), F.monotonically_increasing_id().alias("place"))
        return rows.filter("r.page_id is not null and r.hash is not null").select("r.*", "place")

    def states(self) -> DataFrame:
        """page_id, page_version, content_hash, chunk_count of pages as last committed, without deleted ones."""
        if not self.exists():
            return self.spark.createDataFrame([], "page_id string, page_version long, content_hash string, chunk_count long")
        last = self.lines().groupBy("page_id").agg(F.max_by(F.struct("version", "hash", "chunks"), F.struct("commit", "place")).alias("r"))
        return last.filter("r.hash <> ''").select("page_id", F.col("r.version").alias("page_version"), F.col("r.hash").alias("content_hash"), F.col("r.chunks").alias("chunk_count"))

    def last_commit(self) -> int:
        return (self.lines().agg(F.max("commit")).first()[0] or 0) if self.exists() else 0

    def append(self, states: DataFrame, commit: int) -> None:
        """states: page_id, page_version, content_hash, chunk_count (hash null: deleted)."""
        states.select(
            "page_id", F.col("page_version").cast("long").alias("version"), F.coalesce("content_hash", F.lit("")).alias("hash"), F.coalesce("chunk_count", F.lit(0)).alias("chunks"), F.lit(commit).alias("commit")
        ).write.mode("append").json(self.folder)

    def catch_up(self, store: Store) -> int:
        """Write the lines of commits that the log doesn't know; returns the last commit's number."""
        now, known = store.current() or 0, self.last_commit()
        if now > known:
            new, states, old = store.states_since(known), store.table("page_states"), self.states()
            gone = old.select("page_id").join(states.select("page_id"), "page_id", "left_anti").selectExpr("page_id", "cast(null as long) page_version", "cast(null as string) content_hash", "0L chunk_count")
            self.append(gone if new is None else new.withColumn("page_version", F.col("page_version").cast("long")).unionByName(gone), now)
        return now

    def clear(self) -> None:
        p, fs = self._hadoop()
        fs.delete(p, True)
