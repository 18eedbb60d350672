"""Command line: ``python -m runloom.cli ingest|search|eval|stats|preview|inspect|reset|config|check|serve``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import logs
from .config import Config, load_files
from .functions.providers import embedder_of, reranker_of
from .functions.text import breadcrumb, content_hash
from .operators import chunking, evaluate, normalize
from .plans import ingest as ingest_plan
from .plans.log import Log
from .plans.progress import Progress
from .plans.search import Engine
from .plans.store import Store, sync_check, top_pages
from .sources import content_api, files


def show(df: DataFrame, out=None) -> None:
    for row in df.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False), file=out or sys.stdout)


def wiki_documents(spark: SparkSession, config: Config, raw: DataFrame | None = None) -> DataFrame:
    """Pages of the content API (or of recorded payloads) as documents; those that can't be normalized keep their error, for the report."""
    s = config.source
    if raw is None:
        content_api.register(spark)
        options = {"base_url": s.base_url, "spaces": ",".join(s.spaces), "labels": ",".join(s.labels), "cql": s.query, "token": s.token}
        raw = spark.read.format("content_api").options(**options).load().select(F.from_json("value", files.PAYLOAD).alias("p")).select("p.*")
    pages = normalize.normalize_pages(files.pages_from_payloads(raw, s.base_url))
    return pages.select("page_id", "title", "url", "space_key", "version", "labels", "markdown", content_hash(F.coalesce("markdown", F.lit(""))).alias("content_hash"), "error")


def evaluate_cases(engine: Engine, cases: DataFrame, k: int) -> DataFrame:
    cases = cases.withColumn("query_id", F.xxhash64("query")).withColumnRenamed("query", "text")
    hits = engine.search(cases.select("query_id", "text"), top_k=k).join(engine.store.table("chunks"), "chunk_id").join(cases.drop("text"), "query_id")
    crumb = breadcrumb(F.col("section_path"), F.col("page_title"))
    relevant = evaluate.is_relevant(F.col("relevant_pages"), F.col("relevant_sections"), F.col("page_title"), F.col("page_id"), crumb)
    return evaluate.case_results(cases, hits.withColumn("relevant", relevant), k)


def check(config: Config) -> int:
    """Say what works: the settings, and the wiki's answer to the token; 1 if something doesn't."""
    print(json.dumps(config.summary(), indent=2))
    if not config.source.base_url:
        print("source: no base_url set; local folders only")
        return 0
    try:
        print(f"source: signed in as {content_api.verify(config.source.base_url, config.source.token)}")
        return 0
    except (OSError, ValueError) as e:  # refused, unreachable, or no JSON
        print(f"source: {e}", file=sys.stderr)
        return 1


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="runloom")
    p.add_argument("--folder", help="where the store is")
    p.add_argument("--profile")
    p.add_argument("--config", help="a file of settings")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("ingest")
    s.add_argument("source", choices=["local", "wiki", "payloads"])
    s.add_argument("path", nargs="?")
    s.add_argument("--force", action="store_true")
    s.add_argument("--prune", action="store_true", help="delete pages that the source has no more")
    s.add_argument("--no-resume", action="store_true", help="clear the checkpoint log first")
    s.add_argument("--limit", type=int)
    s = sub.add_parser("search")
    s.add_argument("text")
    s.add_argument("--top-k", type=int, default=0)
    s.add_argument("--space")
    s.add_argument("--kind", action="append")
    s.add_argument("--context", action="store_true")
    s = sub.add_parser("eval")
    s.add_argument("path")
    s.add_argument("--k", type=int, default=6)
    s = sub.add_parser("preview")
    s.add_argument("path")
    for name in ("stats", "inspect", "config", "check"):
        sub.add_parser(name)
    s = sub.add_parser("reindex")
    s.add_argument("--embed", action="store_true", help="make all vectors anew, as after a change of the embedder")
    s = sub.add_parser("reset")
    s.add_argument("--yes", action="store_true")
    s = sub.add_parser("serve")
    s.add_argument("--port", type=int, default=8080)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    config = load_files(args.config, args.profile)
    logs.setup(config.logging.level, config.logging.form)
    if args.command == "config":
        print(json.dumps(config.summary(), indent=2))
        return 0
    if args.command == "check":
        return check(config)
    spark = spark or SparkSession.builder.appName("runloom").getOrCreate()
    store = Store(spark, args.folder or config.folder)
    if args.command in ("ingest", "search", "eval", "serve", "reindex"):  # the others work without the providers
        store.embedder = embedder_of(config.embedding)
    engine = Engine(store, config.retrieval, reranker_of(config.reranking) if args.command in ("search", "eval", "serve") else None)
    c = config.chunking
    if args.command == "ingest":
        if args.source == "local":
            docs = files.read_markdown(spark, args.path)
        else:
            docs = wiki_documents(spark, config, spark.read.schema(files.PAYLOAD).json(args.path) if args.source == "payloads" else None)
        log = Log(spark, f"{store.folder}/log")
        every = config.logging.progress_seconds
        progress = Progress(spark, every) if every > 0 else None
        show(ingest_plan.ingest(store, docs, args.force, args.prune, c.max_tokens, c.min_tokens, c.overlap_tokens, args.limit, log=log, resume=not args.no_resume, progress=progress))
    elif args.command == "search":
        q = spark.createDataFrame([(0, args.text)], "query_id long, text string")
        hits = engine.search(q, {k: v for k, v in (("space_key", args.space), ("section_kind", args.kind)) if v}, args.top_k)
        if args.context:
            show(engine.context(hits))
        else:
            show(hits.join(store.table("chunks").drop("embed_text"), "chunk_id").orderBy("rank"))
    elif args.command == "eval":
        r = evaluate_cases(engine, files.read_golden(spark, args.path), args.k)
        show(evaluate.report(r))
        show(evaluate.misses(r))
    elif args.command == "preview":
        text = open(args.path, encoding="utf-8").read()
        if args.path.endswith((".html", ".xml", ".storage")):
            text = normalize.to_markdown(text)
        doc = {"page_id": "preview", "title": args.path, "url": "", "space_key": "", "version": 1, "labels": [], "markdown": text, "content_hash": ""}
        for row in chunking.chunk_document(doc, c.max_tokens, c.min_tokens, c.overlap_tokens, chunking.estimate):
            print(json.dumps({k: row[k] for k in ("section_path", "section_kind", "token_count", "body_text")}, ensure_ascii=False))
    elif args.command == "stats":
        show(engine.stats())
    elif args.command == "inspect":
        show(sync_check(store.table("chunks"), store.table("lengths")))
        show(top_pages(store.table("chunks")))
    elif args.command == "reindex":
        store.embed_again() if args.embed else store.reindex()
    elif args.command == "reset":
        if not args.yes:
            print("reset drops everything; pass --yes", file=sys.stderr)
            return 2
        store.reset(confirm=True)
        Log(spark, f"{store.folder}/log").clear()
    elif args.command == "serve":
        from .server import serve

        serve(engine, args.port)
    return 0


if __name__ == "__main__":
    sys.exit(main())
