"""Retrieval quality over a set of cases, all in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def is_relevant(pages: Column, sections: Column, title: Column, page_id: Column, crumb: Column) -> Column:
    """A wanted page (by title or id), and a wanted section in its path if any is named; case does not matter."""
    page = F.exists(pages, lambda p: (F.lower(p) == F.lower(title)) | (F.lower(p) == F.lower(page_id)))
    section = F.coalesce(F.size(sections) == 0, F.lit(True)) | F.exists(sections, lambda s: F.contains(F.lower(crumb), F.lower(s)))
    return F.coalesce(page, F.lit(False)) & F.coalesce(section, F.lit(True))


def case_results(cases: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """cases (query_id); judged hits (query_id, rank, relevant) -> hit, first, rr, ndcg of each case."""
    j = judged.filter((F.col("rank") < k) & F.col("relevant"))
    j = j.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1)
    gain = lambda r: 1 / F.log2(r + 2.0)
    a = j.groupBy("query_id").agg(F.min("rank").alias("first"), F.sum(gain(F.col("rank"))).alias("dcg"), F.sum(gain(F.col("place"))).alias("ideal"))
    return cases.select("query_id").join(a, "query_id", "left").select(
        "query_id",
        F.col("first").isNotNull().alias("hit"),
        "first",
        F.coalesce(1 / (F.col("first") + 1), F.lit(0.0)).alias("rr"),
        F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)).alias("ndcg"),
    )


def report(results: DataFrame) -> DataFrame:
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return results.agg(F.count(F.lit(1)).alias("cases"), mean(F.col("hit").cast("double")).alias("recall"), mean("rr").alias("mrr"), mean("ndcg").alias("ndcg"))


def misses(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("hit")).select("query_id")
