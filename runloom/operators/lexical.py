"""BM25 over an inverted index held as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lexemes import counted, terms

K1, B = 1.5, 0.75
#: So many rows of query terms are broadcast at most, some 20 MB.
TERMS = 200_000


def postings(chunks: DataFrame, text: str = "embed_text", with_lengths: bool = False, key: str = "chunk_id") -> DataFrame:
    """chunk_id, text -> chunk_id, term, tf (and the chunk's length, ``dl``)."""
    out = counted(chunks, key, text)
    return out if with_lengths else out.drop("dl")


def lengths(chunks: DataFrame, text: str = "embed_text", key: str = "chunk_id") -> DataFrame:
    return counted(chunks, key, text, by_term=False)


def corpus(doc_lengths: DataFrame) -> DataFrame:
    """One row: n, avgdl."""
    return doc_lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(1e-9), F.log(1 + (n - df + 0.5) / (df + 0.5)))


def term_weights(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """term -> df, idf."""
    d = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # The corpus statistics are one row.
    return d.join(F.broadcast(stats), how="cross").select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, text -> query_id, term; each term of a query once."""
    return queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))


def ranked(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best of each query, rank from 0; near-equal scores go by chunk_id."""
    order = Window.partitionBy("query_id").orderBy(F.round(score, 9).desc(), "chunk_id")
    # Filtered by the window's own column, which lets each task drop all but its k best before the shuffle.
    return scores.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max(1, k)).withColumn("rank", F.col("_n") - 1).drop("_n")


def bm25_scores(queries: DataFrame, posts: DataFrame, doc_lengths: DataFrame, match: str = "any", k1: float = K1, b: float = B, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score.

    Only postings of query terms are weighed and moved. Statistics stay global when
    ``allowed`` (chunk_id) restricts the chunks that may be found. Postings may have
    their chunk's length (``dl``) with them.
    """
    q = query_terms(queries)
    # Dealt by chunk, so that no frequent term is in one task, and read again from the same shuffle below.
    used = posts.join(q.select("term").distinct(), "term", "left_semi").repartition("chunk_id")
    stats = corpus(doc_lengths)
    asked = q.join(term_weights(used, stats).select("term", "idf"), "term")
    # Queries' terms go to where the postings are, as long as there are few: then a chunk's scores are summed where it lies.
    if q.count() <= TERMS:
        asked = F.broadcast(asked)
    found = used if allowed is None else used.join(allowed, "chunk_id", "left_semi")
    avgdl = F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(F.lit(1.0))
    dl = F.greatest(F.col("dl"), F.lit(1))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * dl / avgdl))
    # Made once for each posting, before queries meet it.
    sized = found if "dl" in found.columns else found.join(doc_lengths, "chunk_id")
    weighed = sized.join(F.broadcast(stats.select("avgdl")), how="cross").select("term", "chunk_id", part.alias("part"))
    s = weighed.join(asked, "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("idf") * F.col("part")).alias("score"), F.count(F.lit(1)).alias("hits"))
    if match == "all":
        s = s.join(q.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms")), "query_id").filter("hits = n_terms").drop("n_terms")
    elif match != "any":
        raise ValueError(f"match must be 'any' or 'all', not {match!r}")
    return s.drop("hits")


def bm25_topk(queries: DataFrame, posts: DataFrame, doc_lengths: DataFrame, k: int = 30, **options) -> DataFrame:
    return ranked(bm25_scores(queries, posts, doc_lengths, **options), k)
