"""The index in a folder: chunks, vectors, postings, lengths, page states, in buckets of pages.

A commit writes one generation: the rows of the pages it touches, in the buckets of these pages, and which pages these were. The
manifest, a row of the pointer table, lists for each table and bucket the generations that make it up. Readers merge on read: a
row counts if no later generation touched its page. A bucket of more than MOST generations is compacted into one by the
commit that brought it there, so a commit writes its own pages, and a bucket now and then. A job that dies leaves the last
manifest as it was, and files that no manifest lists go with the next commit. One writer at a time.

Layout: <folder>/data/<table>/gen=<number>/bucket=<b>. Files are sorted: vectors by cell of the vector index, postings by term,
chunks by space and page, so that filters on these skip row groups (by their bounds, and by the dictionaries of pages). Vectors are filed in the cells of ``ivf`` as they come; its centroids are trained on the
first rows and again whenever there are GROWTH times as many. A manifest has a few numbers for each bucket and generation in it.
"""

from __future__ import annotations

import contextlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.hashing import NAME
from ..functions.providers import HASHING, Embedder
from ..operators import ivf
from ..operators.lexical import lengths, postings

TABLES = ("chunks", "vectors", "postings", "lengths", "page_states")
SORTED = {"chunks": ("space_key", "page_id", "section_index", "chunk_index"), "vectors": ("cell", "chunk_id"), "postings": ("term", "chunk_id"), "lengths": ("chunk_id",), "page_states": ("page_id",), "touched": ("page_id",)}
#: Manifests that stay for readers; generations of a bucket before a commit compacts it; growth after which centroids are trained anew.
KEEP, MOST, GROWTH = 2, 4, 4
BUCKETS = 64


def page_states(chunks: DataFrame) -> DataFrame:
    """What is stored of each page."""
    return chunks.groupBy("page_id").agg(F.max("page_version").alias("page_version"), F.max("content_hash").alias("content_hash"), F.count(F.lit(1)).alias("chunk_count"))


def without_pages(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """The chunks of all other pages."""
    return chunks.join(pages.select("page_id").distinct(), "page_id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def by_ids(chunks: DataFrame, ids: list[str]) -> DataFrame:
    """The chunks of some ids, in their order; unknown ids are skipped."""
    if not ids:
        return chunks.limit(0).withColumn("pos", F.lit(0))
    wanted = chunks.sparkSession.createDataFrame([(i, n) for n, i in enumerate(dict.fromkeys(ids))], "chunk_id string, pos int")
    return by_ordinal(chunks, wanted).orderBy("pos")


def by_ordinal(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The chunks that are wanted (chunk_id, pos), however many; unknown ids are skipped."""
    return chunks.join(wanted, "chunk_id")


def section(chunks: DataFrame, page_id: str, index: int) -> DataFrame:
    return chunks.filter((F.col("page_id") == page_id) & (F.col("section_index") == index)).orderBy("chunk_index")


def page(chunks: DataFrame, page_id: str) -> DataFrame:
    return chunks.filter(F.col("page_id") == page_id).orderBy("section_index", "chunk_index")


def flat_metadata(chunks: DataFrame) -> DataFrame:
    """Scalars only: arrays joined, no bodies."""
    return chunks.select(
        "chunk_id", "page_id", "page_title", "page_url", "space_key", "page_version", "content_hash", F.concat_ws(" > ", "section_path").alias("section_path"), "section_kind",
        "section_index", "chunk_index", "token_count", F.concat_ws(",", "labels").alias("labels"),
    )


def from_flat(meta: DataFrame) -> DataFrame:
    parts = lambda c, sep: F.filter(F.split(c, sep), lambda x: x != "")
    return meta.withColumn("section_path", parts("section_path", " > ")).withColumn("labels", parts("labels", ","))


def top_pages(chunks: DataFrame, n: int = 40) -> DataFrame:
    return chunks.groupBy("page_id").agg(F.count(F.lit(1)).alias("chunks")).orderBy(F.desc("chunks"), "page_id").limit(n)


def sync_check(chunks: DataFrame, doc_lengths: DataFrame) -> DataFrame:
    """One row: chunks stored, chunks indexed, whether they agree."""
    a, b = chunks.agg(F.count(F.lit(1)).alias("stored")), doc_lengths.agg(F.count(F.lit(1)).alias("indexed"))
    return a.join(F.broadcast(b), how="cross").withColumn("in_sync", F.col("stored") == F.col("indexed"))


def bucket_of(page_id: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(page_id), F.lit(buckets)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, embedder: Embedder = HASHING) -> None:
        self.spark, self.folder, self.buckets, self.embedder = spark, folder.rstrip("/"), buckets, embedder

    # -- the manifest ----------------------------------------------------------------

    def _pointers(self) -> str:
        return f"{self.folder}/_current"

    def manifests(self, n: int = 1) -> list[dict]:
        """The last n manifests, newest first."""
        from pyspark.errors import AnalysisException

        try:
            rows = self.spark.read.schema("made long, manifest string").parquet(self._pointers()).orderBy(F.desc("made")).limit(n).collect()
        except AnalysisException:
            return []
        return [json.loads(r["manifest"]) for r in rows]

    def current(self) -> int | None:
        """The number of the last commit."""
        now = self.manifests()
        return now[0]["made"] if now else None

    def _hadoop(self, path: str):
        """Hadoop's path, and the file system that it lies in."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, path: str) -> list[str]:
        p, fs = self._hadoop(path)
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    # -- reading -----------------------------------------------------------------------

    def _stored(self, manifest: dict, table: str, buckets: set[int] | None = None) -> DataFrame | None:
        """All rows of the listed generations, with ``gen`` and ``bucket``."""
        top = f"{self.folder}/data/{table}"
        paths = [f"{top}/gen={g}/bucket={b}" for b, gens in manifest["files"].get(table, {}).items() if buckets is None or int(b) in buckets for g in gens]
        if not paths:
            return None
        return self.spark.read.schema(manifest["schemas"][table]).option("basePath", top).parquet(*paths)

    def _live(self, manifest: dict, table: str, buckets: set[int] | None = None) -> DataFrame | None:
        rows = self._stored(manifest, table, buckets)
        touched = self._stored(manifest, "touched", buckets)
        if rows is None or touched is None:
            return rows
        last = touched.groupBy("page_id").agg(F.max("gen").alias("_last"))
        return rows.join(last, "page_id", "left").filter(F.col("_last").isNull() | (F.col("gen") >= F.col("_last"))).drop("_last")

    def table(self, name: str) -> DataFrame | None:
        """The rows that count; None before the first commit."""
        now = self.manifests()
        if not now:
            return None
        rows = self._live(now[0], name)
        if rows is None:
            rows = self.spark.createDataFrame([], now[0]["schemas"][name])
        return rows.drop("gen", "bucket")

    def states_since(self, commit: int) -> DataFrame | None:
        """State of the pages that commits after this one touched; nulls for those they deleted."""
        now = self.manifests()
        touched = self._stored(now[0], "touched") if now else None
        states = self._live(now[0], "page_states") if now else None
        if touched is None or states is None:
            return None
        pages = touched.filter(F.col("gen") > commit).select("page_id").unionByName(states.filter(F.col("gen") > commit).select("page_id")).distinct()
        return pages.join(states.drop("gen", "bucket"), "page_id", "left")

    def check_embedder(self, m: dict) -> None:
        """Vectors of two embedders can't be compared, so a store has those of one."""
        stored = m.get("embedder", NAME)
        if m["files"].get("vectors") and stored != self.embedder.name:
            raise ValueError(f"the stored vectors come from {stored}, not from {self.embedder.name}; embed the store again with it")

    def index(self) -> ivf.Index | None:
        now = self.manifests()
        return ivf.load(self.spark, f"{self.folder}/{now[0]['index']}") if now and now[0]["index"] else None

    def page(self, page_id: str) -> DataFrame:
        """A page's chunks in order; reads its bucket only."""
        return self._of_page(page_id).orderBy("section_index", "chunk_index")

    def section(self, page_id: str, index: int) -> DataFrame:
        return self._of_page(page_id).filter(F.col("section_index") == index).orderBy("chunk_index")

    def _of_page(self, page_id: str) -> DataFrame:
        now = self.manifests()
        if not now:
            raise ValueError("nothing is stored yet")
        b = self.spark.range(1).select(bucket_of(F.lit(page_id), now[0]["buckets"])).first()[0]
        rows = self._live(now[0], "chunks", {b})
        rows = self.spark.createDataFrame([], now[0]["schemas"]["chunks"]) if rows is None else rows
        return rows.drop("gen", "bucket").filter(F.col("page_id") == page_id)

    # -- writing -----------------------------------------------------------------------

    @contextlib.contextmanager
    def staging(self) -> Iterator[Callable[[str, DataFrame], DataFrame]]:
        """A function that writes a frame once and reads it back, so that later uses see the same rows; they go at the end."""
        top = f"{self.folder}/_staging-{time.time_ns()}"

        def stage(name: str, df: DataFrame) -> DataFrame:
            df.write.parquet(f"{top}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{top}/{name}")

        try:
            yield stage
        finally:
            p, fs = self._hadoop(top)
            fs.delete(p, True)

    def commit(self, chunks: DataFrame, touched: DataFrame | None = None, batch: tuple[str, int] | None = None) -> None:
        """Replace the touched pages (page_id; without it, all pages of ``chunks``) by these chunks; a touched page without chunks is deleted.

        ``batch``: a stream's name and batch number, so that a batch that is run again is known.
        """
        now = self.manifests()
        m = now[0] if now else {"made": 0, "buckets": self.buckets, "files": {}, "schemas": {}, "index": None, "trained": 0, "batches": {}}
        if batch and m["batches"].get(batch[0], -1) >= batch[1]:
            return
        self.check_embedder(m)
        m["embedder"] = self.embedder.name
        gen = self._number(m)
        b = bucket_of("page_id", m["buckets"])
        pages = (chunks if touched is None else touched).select("page_id").distinct()
        self._write(m, gen, "touched", pages.withColumn("bucket", b))
        self._write(m, gen, "chunks", chunks.withColumn("bucket", b))
        fresh = self._own(m, gen, "chunks")
        for t, rows in self._lexical(fresh).items():
            self._write(m, gen, t, rows.withColumn("bucket", b))
        n, vectors = fresh.count(), self._embedded(fresh)
        with self.staging() as stage:
            if m["index"] and m["rows"] + n < GROWTH * m["trained"]:
                index = ivf.load(self.spark, f"{self.folder}/{m['index']}")
                m["rows"] += n
            else:
                vectors = stage("vectors", vectors)  # training reads them several times
                index = self._train(m, vectors)
            filed = ivf.filed(vectors, index, "counts") if index else vectors.selectExpr("*", "cast(null as int) cell", "cast(null as binary) code", "cast(null as float) scale")
            self._write(m, gen, "vectors", filed.withColumn("bucket", b))
        full = {int(x) for x, gens in m["files"].get("touched", {}).items() if len(gens) > MOST}
        self._compact(m, full)
        if batch:
            m["batches"][batch[0]] = batch[1]
        self._point(m)

    def _number(self, m: dict) -> int:
        return max(time.time_ns(), m.get("last", 0) + 1)

    def _embedded(self, c: DataFrame) -> DataFrame:
        d = self.embedder.documents(c.withColumn("_k", F.struct("page_id", "chunk_id")), "_k", "embed_text")
        return d.select("_k.*", "counts", F.lit(self.embedder.name).alias("embedder"), F.lit(self.embedder.width).alias("dim"))

    def _lexical(self, c: DataFrame) -> dict[str, DataFrame]:
        """What else is derived from chunks; all have their page."""
        keyed = c.withColumn("_k", F.struct("page_id", "chunk_id"))
        spread = lambda d: d.select("_k.*", *[x for x in d.columns if x != "_k"])
        return {"postings": spread(postings(keyed, key="_k", with_lengths=True)), "lengths": spread(lengths(keyed, key="_k")), "page_states": page_states(c)}

    def _train(self, m: dict, fresh: DataFrame | None) -> ivf.Index | None:
        """Train on all vectors that count, and file the stored ones by it. None if there are no vectors."""
        old = self._live(m, "vectors")
        every = fresh.select("page_id", "chunk_id", "counts", "embedder", "dim") if fresh is not None else None
        if old is not None:
            old = old.drop("bucket", "gen", "cell", "code", "scale")
            every = old if every is None else old.unionByName(every)
        index = None if every is None else ivf.train(every, "counts")
        if index is None:
            return None
        m["index"], m["trained"], m["rows"] = f"index/{self._number(m)}", index.rows, index.rows
        ivf.save(self.spark, index, f"{self.folder}/{m['index']}")
        if old is not None:
            gen = self._number(m)
            m["files"]["vectors"] = {}
            self._write(m, gen, "vectors", ivf.filed(old, index, "counts").withColumn("bucket", bucket_of("page_id", m["buckets"])))
        return index

    def _write(self, m: dict, gen: int, table: str, rows: DataFrame) -> None:
        """Write rows (with their bucket) as a generation, a task for each bucket, and list it in the manifest."""
        path = f"{self.folder}/data/{table}/gen={gen}"
        names = [c for c in rows.columns if c != "bucket"]
        small = self.spark.conf.get("parquet.block.size", None)
        out = rows.select(*names, "bucket").repartition("bucket").sortWithinPartitions("bucket", *SORTED[table])
        # Small row groups, so that a filter on the sorted column skips most of a file.
        out.write.option("parquet.block.size", small or 8 << 20).partitionBy("bucket").parquet(path)
        m["last"] = max(gen, m.get("last", 0))
        m["schemas"][table] = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names] + ["gen long", "bucket int"])
        lists = m["files"].setdefault(table, {})
        for name in self._children(path):
            if name.startswith("bucket="):
                lists.setdefault(name.removeprefix("bucket="), []).append(gen)

    def _own(self, m: dict, gen: int, table: str) -> DataFrame:
        """The rows of one generation."""
        only = {**m, "files": {table: {b: [gen] for b, gens in m["files"].get(table, {}).items() if gen in gens}}}
        rows = self._stored(only, table)
        return self.spark.createDataFrame([], m["schemas"][table]).drop("gen", "bucket") if rows is None else rows.drop("gen", "bucket")

    def _compact(self, m: dict, buckets: set[int]) -> None:
        """Make one generation of the rows that count in each of these buckets."""
        if not buckets:
            return
        live = {t: self._live(m, t, buckets) for t in TABLES}
        gen = self._number(m)
        for t, rows in live.items():
            for b in buckets:
                m["files"].get(t, {}).pop(str(b), None)
            if rows is not None:
                self._write(m, gen, t, rows.drop("gen"))
        for b in buckets:
            m["files"]["touched"].pop(str(b), None)

    def compact(self) -> None:
        """Compact every bucket of more than one generation."""
        now = self.manifests()
        if now:
            m = now[0]
            self._compact(m, {int(b) for b in m["files"].get("touched", {})})
            self._point(m)

    def delete_pages(self, pages: DataFrame) -> int:
        """Delete the chunks of these pages (page_id); returns how many there were."""
        states = self.table("page_states")
        if states is None:
            return 0
        hit = pages.select("page_id").distinct().join(states, "page_id")
        n = hit.agg(F.coalesce(F.sum("chunk_count"), F.lit(0))).first()[0]
        if n:
            self.commit(self.table("chunks").limit(0), hit.select("page_id"))
        return n

    def delete_page(self, page_id: str) -> int:
        return self.delete_pages(self.spark.createDataFrame([(page_id,)], "page_id string"))

    def reindex(self) -> None:
        """Tokenize all chunks anew, as after a change of the tokenizer, and train the vector index again; vectors are taken over as they are."""
        now = self.manifests()
        if not now:
            raise ValueError("nothing is stored yet")
        m = now[0]
        c, vectors, b = self.table("chunks"), self._live(m, "vectors"), bucket_of("page_id", m["buckets"])
        if vectors is not None:
            self._train(m, None)
            made, gen = self._lexical(c), self._number(m)
            for t in ("postings", "lengths"):
                m["files"][t] = {}
                self._write(m, gen, t, made[t].withColumn("bucket", b))
        self._point(m)

    def embed_again(self) -> None:
        """Replace all vectors by those of this store's embedder, and train the vector index on them."""
        now = self.manifests()
        if not now:
            raise ValueError("nothing is stored yet")
        m, b = now[0], bucket_of("page_id", now[0]["buckets"])
        m["files"]["vectors"], m["embedder"] = {}, self.embedder.name
        with self.staging() as stage:
            vectors = stage("vectors", self._embedded(self.table("chunks")))
            if (index := self._train(m, vectors)) is not None:
                self._write(m, self._number(m), "vectors", ivf.filed(vectors, index, "counts").withColumn("bucket", b))
        self._point(m)

    def _point(self, m: dict) -> None:
        """Make a manifest the current one, and drop what none of the last KEEP lists."""
        m["made"] = self._number({"last": m["made"]})
        self.spark.createDataFrame([(m["made"], json.dumps(m))], "made long, manifest string").coalesce(1).write.mode("append").parquet(self._pointers())
        kept = self.manifests(KEEP)
        used = {(t, g) for k in kept for t, lists in k["files"].items() for gens in lists.values() for g in gens}
        for t in self._children(f"{self.folder}/data"):
            for name in self._children(f"{self.folder}/data/{t}"):
                if name.startswith("gen=") and (t, int(name.removeprefix("gen="))) not in used:
                    self._drop(f"{self.folder}/data/{t}/{name}")
        for name in self._children(f"{self.folder}/index"):
            if f"index/{name}" not in {k["index"] for k in kept}:
                self._drop(f"{self.folder}/index/{name}")

    def _drop(self, path: str) -> None:
        p, fs = self._hadoop(path)
        fs.delete(p, True)

    def reset(self, confirm: bool = False) -> None:
        """Drop everything, older manifests' files included; asks to be told that this is meant."""
        if not confirm:
            raise ValueError("reset drops everything; pass confirm=True")
        now = self.manifests()
        if now:
            m = now[0] | {"files": {}, "index": None, "trained": 0, "rows": 0, "batches": {}}
            for _ in range(KEEP):  # so that no manifest that is kept lists anything
                self._point(m)
