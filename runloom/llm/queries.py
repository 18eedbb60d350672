"""The thin ``opN_*`` queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .ann import nearest
from .bestfit import pack_best_fit
from .common import table, tokenizer_path
from .hardneg import hard_negatives
from .html_main import extract_pages
from .langid import held_out, identify
from .mixing import mix
from .packing import pack
from .pii import find_pii
from .quality import score_quality
from .records import token_records
from .sharding import shard_documents
from .simhash import fingerprint_hex, near_duplicates
from .upsert import new_folder, upsert_clients


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = score_quality(table(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 9).alias("posterior"))


def op2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), keep_cache=True)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"), ["doc_id"]).drop("redacted")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(F.col("doc_id"))
    found = identify(table(spark, sf_dir, "documents"), ~out, ["doc_id"])
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shard_documents(table(spark, sf_dir, "documents"), n_shards=8)
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), keep_cache=True).drop("ids")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), keep_cache=True).drop("ids")


def op13_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of floor(clients / 1500) + 1 rows, brought up to ``client_changes``, in a new folder that stays."""
    return upsert_clients(table(spark, sf_dir, "clients"), table(spark, sf_dir, "client_changes"), new_folder(spark, "clients"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_records": op2_records,
    "op3_pii": op3_pii,
    "op4_ann": op4_ann,
    "op5_simhash": op5_simhash,
    "op6_html": op6_html,
    "op7_langid": op7_langid,
    "op8_shard": op8_shard,
    "op9_mix": op9_mix,
    "op10_pack": op10_pack,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_best_fit": op12_best_fit,
    "op13_upsert": op13_upsert,
}
