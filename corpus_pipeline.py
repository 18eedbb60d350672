"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

All but the last return the columns of documents. Decisions take effect: documents
that the quality model rejects go, one document of each near-duplicate group
stays, personal data is replaced by its kind in the text, the mix repeats and leaves out
blocks of its sources, and the last stage returns packed pieces with their token ids.

Cases, in every stage: null and empty texts are documents without words (quality rejects them; the other stages
would keep one of them, leave them as they are, take nothing of them, and pack their end id). Null ids are
ids like any other. Repeated rows are judged alike, one of them stays. Texts of any length are handled whole. Empty tables
give empty results. Further columns, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runloom.llm.common import drop, scratch, table, tokenizer_path
from runloom.llm.mixing import mix_documents
from runloom.llm.packing import pack
from runloom.llm.pii import redact_documents
from runloom.llm.quality import keep_good
from runloom.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go (operator 1)."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, Jaccard similarity 0.8 or more."""
    return keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind (operator 3); n_chars follows the text."""
    return redact_documents(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target weights (operator 9)."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences along a space-filling curve (operator 10)."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: The stages run sequence models and tokenizers, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
