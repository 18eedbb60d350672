"""Batched hybrid search: all queries run in one plan."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..functions.providers import HASHING, Embedder, Scorer
from ..functions.signals import query_variants
from ..functions.text import squeeze
from ..operators import ivf
from ..operators.dense import dense_topk, merge_variants
from ..operators.filters import predicate
from ..operators.fusion import expand, fuse, relink, render, rerank
from ..operators.lexical import bm25_topk
from .store import Store

log = logging.getLogger(__name__)


@dataclass
class Settings:
    dense_k: int = 30
    lexical_k: int = 30
    fused_k: int = 20
    final_k: int = 6
    rrf_k: int = 60
    dense_weight: float = 1.0
    lexical_weight: float = 1.0
    dense_variants: int = 2
    match: str = "any"
    lexical_filters: bool = True
    #: Without it, searches go by vectors alone.
    lexical: bool = True


def dense_hits(queries: DataFrame, vectors: DataFrame, s: Settings, index: ivf.Index | None = None, embedder: Embedder = HASHING, used: list[DataFrame] | None = None) -> DataFrame:
    """query_id, text: the first variants of each query, merged by their best score. With an index, by its cells."""
    v = query_variants(queries).filter(F.col("ord") < s.dense_variants)
    keyed = v.select(F.struct("query_id", "ord").alias("v"), "variant").withColumn("query_id", F.to_json("v"))
    q = embedder.queries(keyed, "query_id", "variant").withColumnRenamed("counts", "embedding")
    if embedder.dear:  # several steps read the vectors; each request should be made once
        q = q.persist()
        if used is not None:
            used.append(q)
    v = vectors.withColumnRenamed("counts", "embedding")
    hits = dense_topk(q, v.select("chunk_id", "embedding"), s.dense_k) if index is None else ivf.search(q, v, index, s.dense_k)
    id_type = queries.schema["query_id"].dataType.simpleString()
    back = F.from_json("query_id", f"query_id {id_type}, ord int")["query_id"]
    return merge_variants(hits.select(back.alias("query_id"), "chunk_id", "score"), s.dense_k)


def hybrid(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, posts: DataFrame, doc_lengths: DataFrame, filters: dict[str, Any] | None = None, settings: Settings | None = None, top_k: int = 0, index: ivf.Index | None = None, embedder: Embedder = HASHING, scorer: Callable[[], Scorer] | None = None, used: list[DataFrame] | None = None) -> DataFrame:
    """query_id, text -> the best chunks of each query. Blank queries find nothing.

    Without postings, or where settings say so, vectors alone are searched. ``scorer`` reranks what fusion leaves, by each query's first variant and
    the text that was embedded. ``used`` takes the frames that were persisted.

    With an index, vectors are searched by its cells, unless filters leave some chunks only: these are searched exactly.
    """
    s = settings or Settings()
    queries = queries.filter(squeeze(F.coalesce("text", F.lit(""))) != "")
    p = predicate(filters)
    allowed = None if p is None else chunks.filter(p).select("chunk_id")
    d = dense_hits(queries, vectors if allowed is None else vectors.join(allowed, "chunk_id", "left_semi"), s, index if allowed is None else None, embedder, used)
    joined = query_variants(queries).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("ord", "variant"))).alias("v"))
    joined = joined.select("query_id", F.array_join(F.transform("v", lambda x: x["variant"]), " ").alias("text"))
    if s.lexical and posts is not None and doc_lengths is not None:
        x = relink(bm25_topk(joined, posts, doc_lengths, s.lexical_k, match=s.match, allowed=allowed if s.lexical_filters else None), chunks)
    else:
        log.warning("no lexical index is used: vectors alone are searched")
        x = d.filter(F.lit(False))
    fused = fuse(d, x, s.fused_k, s.rrf_k, s.dense_weight, s.lexical_weight)
    texts = None
    if scorer is not None:
        asked = query_variants(queries).filter("ord = 0").select("query_id", F.col("variant").alias("query"))
        texts = fused.select("query_id", "chunk_id").join(chunks.select("chunk_id", F.col("embed_text").alias("body")), "chunk_id").join(asked, "query_id")
    return rerank(fused, top_k or s.final_k, scorer, texts)


class Engine:
    def __init__(self, store: Store, settings: Settings | None = None, scorer: Callable[[], Scorer] | None = None) -> None:
        self.store, self.settings, self.scorer = store, settings or Settings(), scorer
        self._used: list[DataFrame] = []

    def search(self, queries: DataFrame, filters: dict[str, Any] | None = None, top_k: int = 0) -> DataFrame:
        if self.store.current() is None:
            raise ValueError("the store is empty; ingest first")
        self.store.check_embedder(self.store.manifests()[0])
        for old in self._used:  # query vectors of the search before; results that are still read make them again
            old.unpersist()
        self._used.clear()
        t = {n: self.store.table(n) for n in ("chunks", "vectors", "postings", "lengths")}
        return hybrid(queries, t["chunks"], t["vectors"], t["postings"], t["lengths"], filters, self.settings, top_k, self.store.index(), self.store.embedder, self.scorer, self._used)

    def context(self, hits: DataFrame, whole_sections: bool = True, max_chars: int = 12_000) -> DataFrame:
        chunks = self.store.table("chunks")
        found = expand(hits, chunks) if whole_sections else hits.join(chunks, "chunk_id").withColumn("pos", F.col("rank"))
        return render(found, max_chars)

    def stats(self) -> DataFrame:
        c = self.store.table("chunks")
        return c.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("page_id").alias("pages"))
