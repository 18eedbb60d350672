"""BM25 top k without reading what can't matter: postings in blocks with bounds, and threshold passes.

Documents are put in blocks of about BLOCK documents of similar length (short ones have the greatest impacts), the same blocks for all
terms. ``maxima`` keeps, for each term and block, the greatest term frequency and the least length there, which bound the term's
part of any score in the block. So for a query, a block's bound is a sum over the query's terms, made from ``maxima`` alone.

1. The k blocks of the greatest bounds (FIRST at least) are read and scored: their k-th score is the query's threshold.
2. Of all other blocks only those whose bound reaches the threshold are read.

A row of the index is a term's list in one block, with its bounds beside it. Rows are dealt by block, once when the index is made and once when it is searched, so a term of
all documents is as many rows as there are blocks, and a document's parts are summed where its block lies: no row is moved for a
document and a query. Rows equal those of ``bm25_topk``: a block that is left out holds no score as good as the threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .lexical import B, K1, TERMS, corpus, idf, query_terms, ranked

BLOCK, FIRST = 128, 4
#: Documents within a sixteenth of a doubling in length are of one level; there are a few hundred levels at most.
STEPS = 16
#: What rounding may add to a sum, so that a tie with the threshold is not left out.
SLACK = 1e-8
#: Scores of documents and queries that a task sums at most, unless a block by itself has more.
SCORES = 1 << 20


@dataclass
class Blocks:
    """``lists``: term, block, tf, dl, n and docs (chunk_id, tf, dl of each document); ``stats``: one row, n and avgdl."""

    lists: DataFrame
    stats: DataFrame

    @property
    def maxima(self) -> DataFrame:
        """term, block, tf, dl, n."""
        return self.lists.drop("docs")

    @property
    def postings(self) -> DataFrame:
        """term, block, chunk_id, tf, dl."""
        return self.lists.select("term", "block", F.inline("docs"))

    def write(self, path: str) -> Blocks:
        self.lists.sortWithinPartitions("term", "block").write.parquet(f"{path}/lists")
        self.stats.coalesce(1).write.parquet(f"{path}/stats")
        return load(self.lists.sparkSession, path)


def load(spark: SparkSession, path: str) -> Blocks:
    return Blocks(*(spark.read.parquet(f"{path}/{n}") for n in ("lists", "stats")))


def blocks(posts: DataFrame, doc_lengths: DataFrame, size: int = BLOCK) -> Blocks:
    """posts: chunk_id, term, tf, dl."""
    level = lambda dl: F.floor(F.log2(F.greatest(dl, F.lit(1))) * STEPS)
    # One row a level.
    salts = doc_lengths.groupBy(level(F.col("dl")).alias("level")).agg(F.ceil(F.count(F.lit(1)) / size).alias("salts"))
    p = posts.withColumn("level", level(F.col("dl"))).join(F.broadcast(salts), "level")
    block = F.shiftleft("level", 40) + F.pmod(F.xxhash64("chunk_id"), F.col("salts"))
    # A document's postings stay together, which also lets them compress. By block, so lists need no other exchange.
    p = p.select("term", block.alias("block"), "chunk_id", "tf", "dl").repartition("block")
    docs = F.collect_list(F.struct("chunk_id", "tf", "dl")).alias("docs")
    lists = p.groupBy("term", "block").agg(F.max("tf").alias("tf"), F.min("dl").alias("dl"), F.count(F.lit(1)).alias("n"), docs)
    return Blocks(lists, corpus(doc_lengths))


def part(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """What BM25 gives to a term but for its idf; greater for more frequent terms and shorter documents."""
    mean = F.when(avgdl > 0, avgdl).otherwise(F.lit(1.0))
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.greatest(dl, F.lit(1)) / mean))


def weighed_terms(queries: DataFrame, index: Blocks) -> DataFrame:
    """query_id, term, idf, avgdl of terms that occur; df comes from ``maxima``."""
    q = query_terms(queries)
    df = index.maxima.join(q.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    w = df.join(F.broadcast(index.stats), how="cross").select("term", idf(F.col("n"), F.col("df")).alias("idf"), "avgdl")
    return q.join(w, "term")


def bounds(terms: DataFrame, index: Blocks) -> DataFrame:
    """query_id, block, bound, place (from 1, by falling bound)."""
    m = terms.join(index.maxima, "term")
    b = m.groupBy("query_id", "block").agg(F.sum(F.col("idf") * part(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("bound"))
    return b.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")))


def scored(pairs: DataFrame, terms: DataFrame, index: Blocks, parts: int, few: bool = False) -> DataFrame:
    """Scores of all documents with a query's term in the blocks it reads (query_id, block). ``few``: there are so few pairs that they are broadcast."""
    readers = pairs.groupBy("block").agg(F.collect_set("query_id").alias("readers"))
    lists = index.lists.select("term", "block", "docs").join(terms.select("term").distinct(), "term", "left_semi")
    if few:
        lists = lists.join(F.broadcast(readers.select("block")), "block", "left_semi")
    lists = lists.repartition(parts, "block")
    read = lists.join(readers, "block").join(terms, "term").filter(F.array_contains("readers", F.col("query_id")))
    p = read.select("query_id", "block", "idf", "avgdl", F.inline("docs"))
    s = p.groupBy("query_id", "block", "chunk_id").agg(F.sum(F.col("idf") * part(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("score"))
    return s.select("query_id", "chunk_id", "score")


@dataclass
class Passes:
    """The two passes of a search: the blocks that each reads, and the scores found."""

    first: DataFrame
    second: DataFrame
    terms: DataFrame
    scores: DataFrame


def passes(queries: DataFrame, index: Blocks, k: int, first: int | None = None) -> Passes:
    first = max(FIRST, k) if first is None else first
    terms = weighed_terms(queries, index)
    asked, n = queries.count(), index.stats.agg(F.max("n")).first()[0] or 0
    # Queries' terms go to where the lists are, as long as there are few.
    if terms.count() <= TERMS:
        terms = F.broadcast(terms)
    # Scores that a task holds at once.
    parts = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-asked * n // SCORES))
    b = bounds(terms, index)
    one = b.filter(F.col("place") <= first)
    near = scored(one, terms, index, parts, asked * first <= TERMS)
    threshold = ranked(near, k).filter(F.col("rank") == max(1, k) - 1).select("query_id", F.col("score").alias("least"))
    two = b.filter(F.col("place") > first).join(threshold, "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))
    return Passes(one, two, terms, near.unionByName(scored(two, terms, index, parts)))


def topk(queries: DataFrame, index: Blocks, k: int = 30) -> DataFrame:
    """query_id, text -> the same rows as ``bm25_topk``."""
    return ranked(passes(queries, index, k).scores, k)


def reading(p: Passes, index: Blocks, least: float = 0.1) -> DataFrame:
    """One row: of the blocks of terms that at least the share ``least`` of all documents holds, how many queries asked about and how many they read."""
    n = index.stats.select("n")
    frequent = index.maxima.groupBy("term").agg(F.sum("n").alias("df")).join(F.broadcast(n), how="cross").filter(F.col("df") >= least * F.col("n")).select("term")
    asked = p.terms.join(frequent, "term", "left_semi").join(index.maxima.select("term", "block"), "term")
    read = p.first.select("query_id", "block").unionByName(p.second.select("query_id", "block")).withColumn("read", F.lit(1))
    return asked.join(read, ["query_id", "block"], "left").agg(F.count(F.lit(1)).alias("asked"), F.coalesce(F.sum("read"), F.lit(0)).alias("read"))
