"""Readers of Markdown folders, golden sets, checkpoints and recorded page payloads."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import content_hash

PAYLOAD = (
    "id string, title string, body struct<storage:struct<value:string>>, version struct<number:int,when:string>, space struct<key:string>, "
    "ancestors array<struct<title:string>>, metadata struct<labels:struct<results:array<struct<name:string>>>>, history struct<lastUpdated:struct<when:string>>, "
    "_links struct<webui:string,base:string>"
)


def title_case(x):
    """Each run of letters begins with a capital and goes on in lower case."""
    parts = F.regexp_extract_all(x, F.lit(r"(?U)(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 20)))), "")


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*.md`` below a folder, one document a file."""
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    root = re.sub(r"^file:/*", "/", folder).rstrip("/") + "/"
    relative = F.regexp_replace(F.regexp_replace(path, r"^file:/*", "/"), f"^{re.escape(root)}", "")
    stem = F.regexp_replace(F.element_at(F.split(relative, "/"), -1), r"\.md$", "")
    first = F.regexp_extract("value", r"^\s*# ([^\n]*)", 1)
    return files.select(
        F.concat(F.lit("local:"), relative).alias("page_id"),
        F.when(first != "", F.trim(first)).otherwise(title_case(F.translate(stem, "-_", "  "))).alias("title"),
        path.alias("url"),
        F.lit("LOCAL").alias("space_key"),
        F.unix_timestamp("_metadata.file_modification_time").cast("int").alias("version"),
        F.array(F.lit("runbook"), F.lit("local")).alias("labels"),
        F.col("value").alias("markdown"),
        content_hash(F.col("value")).alias("content_hash"),
    )


def pages_from_payloads(raw: DataFrame, base_url: str = "") -> DataFrame:
    """Rows of the PAYLOAD schema -> pages; without an id or a body there is no page. A page without a version has version 0."""
    names = lambda xs, f: F.filter(F.transform(F.coalesce(xs, F.array()), f), lambda n: n.isNotNull() & (n != ""))
    base = F.coalesce(F.col("_links.base"), F.lit(base_url))
    return raw.filter("id is not null and id <> '' and body.storage.value <> ''").select(
        F.col("id").alias("page_id"),
        F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Page "), F.col("id"))).alias("title"),
        F.coalesce("space.key", F.lit("")).alias("space_key"),
        F.coalesce("version.number", F.lit(0)).alias("version"),
        F.col("body.storage.value").alias("storage_html"),
        F.concat(base, F.coalesce("_links.webui", F.lit(""))).alias("url"),
        names(F.col("metadata.labels.results"), lambda x: x["name"]).alias("labels"),
        names(F.col("ancestors"), lambda x: x["title"]).alias("ancestors"),
        F.coalesce("history.lastUpdated.when", "version.when").alias("updated_at"),
    )


def read_payloads(spark: SparkSession, path: str, base_url: str = "") -> DataFrame:
    return pages_from_payloads(spark.read.schema(PAYLOAD).json(path), base_url)


GOLDEN = "query string, relevant_pages array<string>, relevant_sections array<string>, notes string"


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSONL file; blank lines and # comments are skipped, a bad line is an error that names its file and line."""
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    lines = whole.select("file", F.posexplode(F.split("value", "\r?\n", -1)).alias("n", "value")).select("file", (F.col("n") + 1).alias("n"), F.trim("value").alias("value"))
    lines = lines.filter("value <> '' and not startswith(value, '#')")
    case = F.from_json("value", GOLDEN, {"mode": "PERMISSIVE"})
    lines = lines.withColumn("case", case)
    bad = F.raise_error(F.concat(F.lit("bad case in "), F.col("file"), F.lit(":"), F.col("n").cast("string"), F.lit(": "), F.col("value")))
    return lines.select(F.when(F.col("case.query").isNull(), bad.cast("string")).otherwise(F.col("case.query")).alias("query"), "case.relevant_pages", "case.relevant_sections", "case.notes")


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """page_id, version, hash, chunks of a JSONL file: torn lines are skipped, the last row of a page wins."""
    rows = spark.read.text(path).select(F.from_json("value", "page_id string, version long, hash string, chunks int").alias("r"), F.monotonically_increasing_id().alias("line"))
    rows = rows.filter("r.page_id is not null and r.hash is not null")
    last = Window.partitionBy("r.page_id").orderBy(F.desc("line"))
    return rows.withColumn("n", F.row_number().over(last)).filter("n = 1").select("r.*")
