import json
import math

import pytest
from pyspark.sql import functions as F

from runloom.operators import evaluate, filters, fusion, lexical
from runloom.plans.ingest import ingest
from runloom.plans.search import Engine
from runloom.plans.store import Store
from runloom.server import answer
from runloom.sources import content_api, files

DOC = "page_id string, title string, url string, space_key string, version int, labels array<string>, markdown string, content_hash string"


def docs(spark, *rows):
    return spark.createDataFrame([(p, t, f"https://example.test/{p}", s, v, ["l"], m, f"h{hash((p, m)) % 10**9}") for p, t, s, v, m in rows], DOC)


A = ("a", "Databases", "OPS", 1, "## Remediation\n\n1. Restart the pool.\n2. org.postgresql.util.PSQLException FATAL sorry too many clients means the pool is full.\n\n## Rollback\n\nUndo it.")
B = ("b", "Consumer lag", "DEV", 1, "## Diagnosis\n\nKafka consumer lag rises when partitions stall.")


def test_bm25_and_match_modes(spark):
    c = spark.createDataFrame([("a", "databases pool"), ("b", "PSQLException too many clients"), ("c", "consumer lag")], "chunk_id string, embed_text string")
    p, n = lexical.postings(c), lexical.lengths(c)
    q = spark.createDataFrame([(1, "PSQLException too many clients"), (2, "unknownterm"), (3, ""), (4, "databases clients"), (5, 'a AND "b* NEAR(')], "query_id int, text string")
    hits = lexical.bm25_topk(q, p, n, 5).collect()
    assert [(h.query_id, h.chunk_id) for h in sorted(hits, key=lambda h: (h.query_id, h.rank))] == [(1, "b"), (4, "a"), (4, "b")]
    assert lexical.bm25_topk(q, p, n, 5, match="all").filter("query_id = 4").count() == 0
    idf = math.log(1 + (3 - 1 + 0.5) / 1.5)
    h = next(h for h in hits if h.chunk_id == "a")
    assert h.score == pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / (10 / 3))))


def test_fusion_ranks(spark):
    hits = lambda *ids: spark.createDataFrame([(1, c, i) for i, c in enumerate(ids)], "query_id int, chunk_id string, rank int")
    out = {r.chunk_id: r for r in fusion.fuse(hits("d", "s"), hits("l", "s")).collect()}
    assert out["s"].rank == 0 and out["s"].source == "hybrid" and out["d"].source == "dense" and out["l"].source == "lexical"
    assert out["s"].score == pytest.approx(2 / 62) and out["d"].rank == 1 and out["l"].rank == 2
    scored = fusion.rerank(fusion.fuse(hits("d", "s"), hits("l")), 2, lambda: lambda q, b: [float(len(x)) for x in b], spark.createDataFrame([(1, "d", "q", "x"), (1, "s", "q", "xxx"), (1, "l", "q", "xx")], "query_id int, chunk_id string, query string, body string"))
    assert [r.chunk_id for r in scored.orderBy("rank").collect()] == ["s", "l"]


def test_filters(spark):
    d = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "C")], "page_id string, space_key string")
    got = lambda f: sorted(r.page_id for r in filters.apply(d, f).collect())
    assert got({"space_key": "A"}) == ["1"] and got({"space_key": ["A", "C"]}) == ["1", "3"] and got({"space_key": []}) == ["1", "2", "3"] and got(None) == ["1", "2", "3"]
    with pytest.raises(ValueError):
        filters.predicate({"body": "x"})


@pytest.mark.parametrize("rel,rr,ndcg", [("000", 0, 0), ("100", 1, 1), ("010", 0.5, 0.63093), ("110", 1, 1), ("011", 0.5, 0.693426)])
def test_metrics(spark, rel, rr, ndcg):
    cases = spark.createDataFrame([(1,)], "query_id int")
    hits = spark.createDataFrame([(1, i, x == "1") for i, x in enumerate(rel)], "query_id int, rank int, relevant boolean")
    r = evaluate.case_results(cases, hits, 3).first()
    assert (r.rr, round(r.ndcg, 6)) == (rr, ndcg)


def test_relevance(spark):
    d = spark.createDataFrame([(["P1"], None, "x", "p1", "c"), (["Title"], ["fix"], "title", "p", "A > Fixes"), (["Title"], ["no"], "title", "p", "A"), ([], ["A"], "t", "p", "A"), (None, None, "t", "p", "A")], "a array<string>, b array<string>, t string, p string, c string")
    assert [r.y for r in d.select(evaluate.is_relevant(*map(F.col, "abtpc")).alias("y")).collect()] == [True, True, False, False, False]


def test_ingest_search_and_changes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError):
        Engine(store).search(spark.createDataFrame([(1, "x")], "query_id long, text string"))
    r = ingest(store, docs(spark, A, B, ("z", "Blank", "OPS", 1, "  "))).first()
    assert (r.seen, r.changed, r.skipped, r.failed, r.chunks) == (3, 2, 1, 0, 3)
    r = ingest(store, docs(spark, A, B)).first()
    assert (r.changed, r.chunks) == (0, 0)
    assert ingest(store, docs(spark, A), force=True).first().changed == 1 and store.table("chunks").count() == 3
    edited = (*A[:3], 2, "## Remediation\n\nOnly this is left now.")
    assert ingest(store, docs(spark, edited)).first().chunks == 1
    assert store.table("chunks").filter("page_id = 'a'").count() == 1 and store.table("chunks").count() == 2
    ingest(store, docs(spark, A))
    e = Engine(store)
    q = spark.createDataFrame([(1, "PSQLException too many clients"), (2, "   ")], "query_id long, text string")
    hits = e.search(q)
    assert hits.filter("query_id = 1 and rank = 0").first().source == "hybrid" and hits.filter("query_id = 2").count() == 0
    text = e.context(hits).first().context
    assert "Databases" in text and "https://example.test/a" in text and "1. Restart the pool." in text
    assert {r.space_key for r in e.search(q, {"space_key": "DEV"}).join(store.table("chunks"), "chunk_id").collect()} == {"DEV"}
    code, out = answer(e, "POST", "/v1/search", json.dumps({"query": "consumer lag", "top_k": 1}).encode())
    assert code == 200 and out["chunks"][0]["page_id"] == "b" and answer(e, "POST", "/v1/search", b"{}")[0] == 422
    assert answer(e, "GET", "/healthz")[0] == 200 and answer(e, "GET", "/v1/stats")[1]["pages"] == 2 and answer(e, "GET", "/x")[0] == 404
    ingest(store, docs(spark, B), prune_missing=True)
    assert {r.page_id for r in store.table("page_states").collect()} == {"b"}
    with pytest.raises(ValueError):
        store.reset()
    store.reset(confirm=True)
    assert store.table("chunks").count() == 0


def test_only_changed_pages_are_embedded(spark, tmp_path):
    from dataclasses import replace

    from runloom.plans import store as stores

    embedded, real = [], stores.HASHING
    told = replace(real, documents=lambda rows, *a: embedded.append({r.page_id for r in rows.select("page_id").collect()}) or real.documents(rows, *a))
    rows = lambda s, t: sorted(map(tuple, s.table(t).drop("embedder", "cell", "code", "scale").collect()), key=repr)
    store, anew = (Store(spark, str(tmp_path / name), embedder=told) for name in ("store", "anew"))
    ingest(store, docs(spark, A, B))
    edited = (*A[:3], 2, "## Remediation\n\nOnly this is left now.")
    ingest(store, docs(spark, edited, B))
    assert embedded == [{"a", "b"}, {"a"}]
    ingest(anew, docs(spark, edited, B))
    assert all(rows(store, t) == rows(anew, t) for t in stores.TABLES)
    now = store.current()
    assert ingest(store, docs(spark, edited, B)).first().changed == 0 and store.current() == now and len(embedded) == 3
    store.reindex()
    assert store.current() != now and len(embedded) == 3 and all(rows(store, t) == rows(anew, t) for t in stores.TABLES)
    assert not any(f.name.startswith("_staging") for f in (tmp_path / "store").iterdir())


def test_a_commit_writes_what_changed(spark, tmp_path):
    from runloom.plans import store as stores

    pages = [(f"p{i}", f"Page {i}", "OPS", 1, "\n\n".join(f"## Part {j}\n\n" + " ".join(f"word{(i * 31 + j * 7 + k) % 1009}" for k in range(120)) for j in range(6))) for i in range(300)]
    folder = tmp_path / "store"
    store = Store(spark, str(folder), buckets=16)
    ingest(store, docs(spark, *pages))
    sizes = lambda: {f: f.stat().st_size for f in folder.rglob("*.parquet")}
    before = sizes()
    assert sum(f.is_relative_to(folder / "data" / "chunks") for f in before) == 16
    body = pages[7][4]
    for version in range(2, 7):
        ingest(store, docs(spark, (*pages[7][:3], version, body + f"\n\n## Version {version}\n\nmore")))
        after = sizes()
        new, whole = sum(after[f] for f in after.keys() - before.keys()), sum(before.values())
        gens = {len(g) for g in store.manifests()[0]["files"]["chunks"].values()}
        # Every few commits, one bucket in sixteen is compacted.
        assert new < (0.02 if version < 1 + stores.MOST else 0.12) * whole and max(gens) <= stores.MOST + 1
        before = after
        assert store.page("p7").filter(F.element_at("section_path", -1).startswith("Version")).count() == 1
    assert store.table("chunks").select("page_id").distinct().count() == 300 and store.table("page_states").filter("page_id = 'p7'").first().page_version == 6
    n = store.page("p8").count()
    assert n and store.delete_page("p8") == n and store.delete_page("p8") == 0 and store.page("p8").count() == 0
    kept = {t: sorted(map(str, store.table(t).collect())) for t in stores.TABLES}
    store.compact()
    assert all(len(g) == 1 for f in store.manifests()[0]["files"].values() for g in f.values()) and "p8" not in {r.page_id for r in store.table("page_states").collect()}
    assert all(sorted(map(str, store.table(t).collect())) == kept[t] for t in stores.TABLES)
    # A page's bucket is all that is read for it, and its pages' rows are skipped by their statistics.
    plan = store.page("p9")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(page_id,p9)" in plan and len(store.page("p9").inputFiles()) == 1
    store.commit(store.table("chunks").limit(0), store.table("chunks").select("page_id").limit(0), ("s", 3))
    now = store.current()
    store.commit(store.table("chunks"), None, ("s", 3))
    assert store.current() == now


def test_index_follows_the_store(spark, tmp_path):
    pages = [(f"p{i}", f"Page {i}", "OPS", 1, f"## Part\n\n{' '.join(f'topic{i % 7}term{k % 5}' for k in range(30))} item{i}") for i in range(120)]
    store = Store(spark, str(tmp_path / "store"), buckets=4)
    ingest(store, docs(spark, *pages[:20]))
    first = store.index()
    ingest(store, docs(spark, *pages[20:40]))
    assert store.index().rows == first.rows == 20 and store.table("vectors").filter("cell is null").count() == 0
    ingest(store, docs(spark, *pages[40:]))  # six times as many: trained and filed anew
    assert store.index().rows == 120 and store.table("vectors").count() == 120
    q = spark.createDataFrame([(i, f"topic{i % 7}term1 item{i}") for i in range(0, 120, 20)], "query_id long, text string")
    best = {r.query_id: r.chunk_id for r in Engine(store).search(q, top_k=1).collect()}
    pages_of = {r.chunk_id: r.page_id for r in store.table("chunks").collect()}
    assert {i: pages_of[c] for i, c in best.items()} == {i: f"p{i}" for i in range(0, 120, 20)}
    store.reset(confirm=True)
    assert not list((tmp_path / "store" / "data").rglob("*.parquet")) and store.table("chunks").count() == 0
    ingest(store, docs(spark, *pages[:3]))
    assert store.table("chunks").count() == 3 and store.index().rows == 3


def test_stream_of_versions_out_of_order(spark, tmp_path):
    from runloom.streaming.ingest import ingest_stream

    body = lambda n: f"## Part\n\nText of version {n}."
    at = lambda p, v: (p, f"Page {p}", "OPS", v, body(v))
    batches = [[at("a", 2), at("b", 1), at("a", 1)], [at("a", 1), at("b", 3), at("b", 2), at("c", 5)], [at("b", 1), at("c", 5), at("a", 4), at("c", 4)]]
    src = tmp_path / "in"
    store = Store(spark, str(tmp_path / "store"), buckets=4)
    for i, rows in enumerate(batches):
        docs(spark, *rows).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(DOC).option("maxFilesPerTrigger", 1).parquet(str(src))
        q = ingest_stream(store, stream, str(tmp_path / "ck"))
        q.awaitTermination(180)
        assert q.exception() is None and store.manifests()[0]["batches"][str(tmp_path / "ck")] == i
    whole = Store(spark, str(tmp_path / "whole"), buckets=4)
    ingest(whole, docs(spark, *[r for rows in batches for r in rows]))
    rows = lambda s: sorted(map(str, s.table("chunks").collect()))
    assert rows(store) == rows(whole) and {r.page_id: r.page_version for r in store.table("page_states").collect()} == {"a": 4, "b": 3, "c": 5}


def test_pages_that_their_source_could_not_give(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), buckets=4)
    ingest(store, docs(spark, A, B))
    d = docs(spark, (*A[:3], 2, ""), B).withColumn("error", F.when(F.col("page_id") == "a", "ValueError: bad markup"))
    r = ingest(store, d, prune_missing=True).first()
    assert (r.seen, r.changed, r.skipped, r.failed) == (2, 0, 1, 1)
    # It keeps what it had.
    assert {x.page_id: x.page_version for x in store.table("page_states").collect()} == {"a": 1, "b": 1}


def test_checkpoint_log(spark, tmp_path):
    from runloom.plans.log import Log

    store, log = Store(spark, str(tmp_path / "store"), buckets=4), Log(spark, str(tmp_path / "log"))
    run = lambda *a, **k: ingest(store, docs(spark, *a), log=log, **k).first()
    assert run(A, B).changed == 2
    line = next(json.loads(x) for f in (tmp_path / "log").glob("part-*") for x in f.read_text().splitlines() if '"a"' in x)
    assert line["page_id"] == "a" and line["chunks"] == 2 and line["hash"] and line["version"] == 1
    # The log alone settles what is done: pages of an emptied store count as done.
    store_now, store.table = store.table, lambda t: None
    assert run(A, B).skipped == 2
    store.table = store_now
    # Without it, the store does; force asks neither.
    assert run(A, resume=False).skipped == 1 and log.exists() and run(A, force=True).changed == 1
    with open(next((tmp_path / "log").glob("part-*")), "a") as f:
        f.write('{"page_id": "trunc')
    next((tmp_path / "log").glob(".part-*.crc")).unlink(missing_ok=True)
    for crc in (tmp_path / "log").glob(".part-*.crc"):
        crc.unlink()
    assert run(A, B).skipped == 2 and {r.page_id for r in log.states().collect()} == {"a", "b"}
    # A commit whose lines were never written is caught up with.
    edited = (*A[:3], 2, "## Remediation\n\nOnly this is left now.")
    ingest(store, docs(spark, edited))
    assert run(edited).skipped == 1 and {r.page_version for r in log.states().filter("page_id = 'a'").collect()} == {2}
    assert run(B, prune_missing=True).skipped == 1 and {r.page_id for r in log.states().collect()} == {"b"}
    assert run(edited, B).changed == 1


def test_readers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "my-v2-3d_note.md").write_text("text only")
    (tmp_path / "b.md").write_text("\n# A Title\nbody")
    (tmp_path / "c.txt").write_text("no")
    rows = {r.page_id: r for r in files.read_markdown(spark, str(tmp_path)).collect()}
    assert set(rows) == {"local:sub/my-v2-3d_note.md", "local:b.md"} and rows["local:b.md"].title == "A Title"
    assert rows["local:sub/my-v2-3d_note.md"].title == "my-v2-3d_note".replace("-", " ").replace("_", " ").title() and rows["local:b.md"].version > 1e9
    g = tmp_path / "g.jsonl"
    g.write_text('# c\n\n{"query": "q", "relevant_pages": ["P"]}\n')
    assert [tuple(r) for r in files.read_golden(spark, str(g)).collect()] == [("q", ["P"], None, None)]
    g.write_text("# c\n\n{broken\n")
    with pytest.raises(Exception, match="g.jsonl:3"):
        files.read_golden(spark, str(g)).collect()
    k = tmp_path / "k.jsonl"
    k.write_text('{"page_id":"a","version":1,"hash":"x","chunks":2}\n{"page_id":"a","version":2,"hash":"y","chunks":3}\n{"page_id":"b","ver')
    assert [tuple(r) for r in files.read_checkpoint(spark, str(k)).collect()] == [("a", 2, "y", 3)]
    p = tmp_path / "p.json"
    p.write_text(json.dumps({"id": "7", "body": {"storage": {"value": "<p>x</p>"}}, "version": {"number": 3}, "space": {"key": "OPS"}, "metadata": {"labels": {"results": [{"name": "l"}]}}, "ancestors": [{"title": "Up"}], "_links": {"webui": "/x", "base": "https://example.test"}}) + "\n" + json.dumps({"id": "8"}))
    (r,) = files.read_payloads(spark, str(p)).collect()
    assert (r.page_id, r.title, r.version, r.url, r.labels, r.ancestors) == ("7", "Page 7", 3, "https://example.test/x", ["l"], ["Up"])


def test_page_query_and_retries():
    import io
    import urllib.error

    assert content_api.page_query(["A"], ["x", 'y"']) == 'type = page and space in ("A") and label in ("x", "y\\"")' and content_api.page_query(override=" z ") == "z"
    assert content_api.count_pages({"totalSize": 5, "size": 1}) == 5 and content_api.count_pages({"size": 1}) == 1 and content_api.count_pages({}) is None
    tries, pauses = [], []
    def opener(request, timeout):
        tries.append(request.full_url)
        if len(tries) < 3:
            raise urllib.error.HTTPError(request.full_url, 503, "busy", {}, None)
        return io.BytesIO(b'{"ok": 1}')
    assert content_api.get_json("https://example.test", {}, opener, pauses.append) == {"ok": 1} and pauses == [1.0, 2.0]
    def denied(request, timeout):
        raise urllib.error.HTTPError(request.full_url, 403, "no", {}, None)
    with pytest.raises(urllib.error.HTTPError):
        content_api.get_json("https://example.test", {}, denied, pauses.append)
    with pytest.raises(PermissionError):
        content_api.verify("https://example.test", "t", denied, pauses.append)
    assert content_api.verify("https://example.test/", "t", lambda r, timeout: io.BytesIO(b'{"displayName": "A B"}')) == "A B"
