"""Weighted reciprocal-rank fusion, reranking, section expansion and rendering."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.providers import Scorer
from ..functions.text import breadcrumb

log = logging.getLogger(__name__)


def fuse(dense: DataFrame, lexical: DataFrame, limit: int = 20, k: int = 60, dense_weight: float = 1.0, lexical_weight: float = 1.0) -> DataFrame:
    """Two ranked lists (query_id, chunk_id, rank) -> one, with the ranks it came from."""
    d = dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"))
    x = lexical.select("query_id", "chunk_id", F.col("rank").alias("lexical_rank"))
    both = d.join(x, ["query_id", "chunk_id"], "full")
    part = lambda c, w: F.when(F.col(c).isNotNull(), w / (F.lit(k) + F.col(c) + 1)).otherwise(F.lit(0.0))
    source = F.when(F.col("lexical_rank").isNull(), "dense").when(F.col("dense_rank").isNull(), "lexical").otherwise("hybrid")
    s = both.withColumn("score", part("dense_rank", dense_weight) + part("lexical_rank", lexical_weight)).withColumn("source", source)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("dense_rank").asc_nulls_last(), F.col("lexical_rank").asc_nulls_last(), "chunk_id")
    return s.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max(1, limit)).withColumn("rank", F.col("_n") - 1).drop("_n")


def relink(lexical: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits whose chunk exists; ranks close up over the others."""
    order = Window.partitionBy("query_id").orderBy("rank")
    return lexical.join(chunks.select("chunk_id"), "chunk_id", "left_semi").withColumn("rank", F.row_number().over(order) - 1)


def rerank(hits: DataFrame, top_k: int, scorer: Callable[[], Scorer] | None = None, texts: DataFrame | None = None) -> DataFrame:
    """The best top_k hits. Without a scorer, in the order that they have.

    ``scorer`` makes a function of (query, bodies) once in each task; ``texts`` gives query_id, chunk_id, query, body of the hits, of which
    a query has a few. Hits without a score keep their order after the others; a query whose scorer fails keeps the order it has.
    """
    if scorer is None:
        return hits.filter(F.col("rank") < max(1, top_k)).withColumn("rerank_score", F.lit(None).cast("double"))
    names = hits.columns
    told = hits.join(texts, ["query_id", "chunk_id"], "left")
    one = F.struct("rank", "chunk_id", F.struct(*names).alias("hit"), F.coalesce("body", F.lit("")).alias("body"))
    asked = told.groupBy("query_id").agg(F.max("query").alias("query"), F.sort_array(F.collect_list(one)).alias("hits"))
    scores = score_queries(scorer)(F.coalesce("query", F.lit("")), F.transform("hits", lambda h: h["body"]))
    each = asked.select(F.explode(F.arrays_zip("hits", scores.alias("score"))).alias("x")).select("x.hits.hit.*", F.col("x.score").alias("rerank_score"))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "rank")
    return each.withColumn("new", F.row_number().over(order) - 1).filter(F.col("new") < max(1, top_k)).drop("rank").withColumnRenamed("new", "rank")


def score_queries(scorer: Callable[[], Scorer]):
    """A pandas UDF (query, bodies) -> scores; what fails is one query, not those that share its batch."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = None
        for queries, bodies in batches:
            out = []
            for q, b in zip(queries, bodies):
                try:
                    score = score or scorer()
                    s = list(score(q, list(b)))
                    if len(s) != len(b):
                        raise ValueError(f"{len(b)} texts have {len(s)} scores")
                except Exception as e:  # the provider's failure: the order of this query stands
                    log.warning("reranking failed, the order stays: %s", e)
                    s = [None] * len(b)
                out.append(s)
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")


def expand(hits: DataFrame, chunks: DataFrame, few: bool = False) -> DataFrame:
    """Whole sections of the hits, by their best hit, then chunk by chunk: query_id, pos, chunk columns.

    Hits may have page_id and section_index with them. ``few``: there are so few hits that they are broadcast, and chunks stay where they are.
    """
    sent = F.broadcast if few else lambda d: d
    if "section_index" not in hits.columns:
        hits = chunks.select("chunk_id", "page_id", "section_index").join(sent(hits), "chunk_id")
    sections = hits.groupBy("query_id", "page_id", "section_index").agg(F.min("rank").alias("section_rank"))
    found = chunks.join(sent(sections), ["page_id", "section_index"])
    order = Window.partitionBy("query_id").orderBy("section_rank", "chunk_index", "chunk_id")
    return found.withColumn("pos", F.row_number().over(order) - 1)


def render(found: DataFrame, max_chars: int = 12_000) -> DataFrame:
    """query_id, pos, chunk columns -> query_id, context: the blocks that fit, from the first on."""
    crumb = breadcrumb(F.col("section_path"), F.col("page_title"))
    block = F.concat(
        F.lit("["), (F.col("pos") + 1).cast("string"), F.lit("] "), F.col("page_title"), F.lit(" — "), crumb, F.lit("\n    source: "), F.col("page_url"),
        F.lit("\n    type: "), F.col("section_kind"), F.lit("\n\n"), F.col("body_text"), F.lit("\n"),
    )
    up_to = Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = found.select("query_id", "pos", block.alias("block")).withColumn("used", F.sum(F.length("block")).over(up_to)).filter(F.col("used") <= max_chars)
    parts = b.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "block"))).alias("b"))
    return parts.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n---\n").alias("context"))
