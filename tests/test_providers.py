"""Providers that settings choose, against a local server of embeddings and rerank scores."""

import hashlib
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest

from runloom import config as C
from runloom.functions import providers
from runloom.operators import fusion
from runloom.plans.ingest import ingest
from runloom.plans.search import Engine, Settings
from runloom.plans.store import Store

DOC = "page_id string, title string, url string, space_key string, version int, labels array<string>, markdown string, content_hash string"
WORDS = "database pool lag kafka disk certificate".split()


def vector(text, width=8):
    """A direction by the words that a text holds."""
    v = np.array([text.lower().count(w) for w in WORDS] + [0.01, 0.0][: width - 6] + [0.0] * max(0, width - 8), dtype=float)
    return (v / np.sqrt((v * v).sum())).tolist()


class Service:
    def __init__(self):
        self.asked, self.failures, self.refused, self.width, self.short = [], [], "", 8, False
        service = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                service.asked.append((self.path, asked))
                if service.failures:
                    code, out = service.failures.pop(), {}
                elif self.headers.get("Authorization") != "Bearer k":
                    code, out = 401, {}
                elif self.path == "/embed":
                    data = [{"index": i, "embedding": vector(t, service.width)} for i, t in enumerate(asked["input"])]
                    code, out = 200, {"data": data[::-1][1:] if service.short else data[::-1]}
                elif service.refused and service.refused in asked["query"]:
                    code, out = 400, {}
                else:
                    scores = [{"index": i, "relevance_score": d.lower().count(asked["query"].split()[0].lower())} for i, d in enumerate(asked["documents"])]
                    code, out = 200, {"data": sorted(scores, key=lambda s: -s["relevance_score"])}
                data = json.dumps(out).encode()
                self.send_response(code)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *a):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"


@pytest.fixture
def service():
    s = Service()
    yield s
    s.server.shutdown()


def settings(service, **more):
    return C.load({"embedding": {"provider": "http", "url": f"{service.url}/embed", "model": "m", "token": "k", "batch": 4} | more}, env={}).embedding


def docs(spark, *rows):
    return spark.createDataFrame([(p, t, f"https://example.test/{p}", "OPS", 1, ["l"], m, hashlib.md5(m.encode()).hexdigest()) for p, t, m in rows], DOC)


PAGES = [("a", "Storage", "## Fix\n\nThe database pool is full; restart the pool."), ("b", "Queues", "## Fix\n\nKafka lag grows, so look at kafka first."), ("c", "Disks", "## Fix\n\nThe disk is full. A disk fills with logs.")]


def test_vectors_come_in_order_and_after_pauses(spark, service):
    service.failures = [503, 429]
    e = providers.embedder_of(settings(service))
    assert (e.name, e.width, e.dear) == ("http:m:8", 8, True)
    service.asked.clear()
    texts = ["database", "  ", None, "", *[f"{w} {i} disk" for i, w in enumerate(WORDS * 3)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = {r.id: r.counts for r in e.documents(rows, "id", "text").collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(vector(t) if t and t.strip() else [0.0] * 8, abs=1e-6)
    # Blank texts are not sent, four texts go in a request, and documents are told from queries.
    assert all(len(a["input"]) <= 4 and a["input_type"] == "document" and all(t.strip() for t in a["input"]) for _, a in service.asked)
    assert sum(len(a["input"]) for _, a in service.asked) == len(texts) - 3
    service.asked.clear()
    e.queries(rows.limit(1), "id", "text").collect()
    assert [a["input_type"] for _, a in service.asked] == ["query"]
    service.short = True
    with pytest.raises(Exception, match="the answer has"):
        e.documents(rows, "id", "text").collect()


def test_shorter_vectors(spark, service):
    service.width = 256
    e = providers.embedder_of(settings(service, dimensions=128))
    assert e.width == 128 and e.name == "http:m:128"
    v = e.documents(spark.createDataFrame([(1, "kafka lag")], "id int, text string"), "id", "text").first().counts
    assert len(v) == 128 and sum(x * x for x in v) == pytest.approx(1, abs=1e-5)
    with pytest.raises(ValueError, match="256 dimensions, fewer than 512"):
        providers.embedder_of(settings(service, dimensions=512))


def test_a_store_has_vectors_of_one_embedder(spark, service, tmp_path):
    folder = str(tmp_path / "s")
    ingest(Store(spark, folder, 2), docs(spark, *PAGES))
    e = providers.embedder_of(settings(service))
    store = Store(spark, folder, 2, e)
    q = spark.createDataFrame([(1, "kafka"), (2, "disk"), (3, " ")], "query_id long, text string")
    for act in (lambda: Engine(store).search(q), lambda: ingest(store, docs(spark, ("d", "New", "## Fix\n\nA certificate.")))):
        with pytest.raises(ValueError, match="hashing-384, not from http:m:8"):
            act()
    store.embed_again()
    assert {(r.embedder, len(r.counts)) for r in store.table("vectors").collect()} == {("http:m:8", 8)} and store.index().centroids.shape[1] == 8
    ingest(store, docs(spark, ("d", "New", "## Fix\n\nA certificate has expired.")))
    assert store.table("vectors").count() == 4
    service.asked.clear()
    engine = Engine(store, Settings(lexical=False))
    titles = {r.chunk_id: r.page_title for r in store.table("chunks").collect()}
    hits = engine.search(q, top_k=1).collect()
    assert {h.query_id: titles[h.chunk_id] for h in hits} == {1: "Queues", 2: "Disks"} and {h.source for h in hits} == {"dense"}
    # Each query was sent once.
    assert sum(len(a["input"]) for _, a in service.asked) == 2
    with pytest.raises(ValueError, match="http:m:8, not from hashing"):
        Engine(Store(spark, folder, 2)).search(q)


def test_rerank_falls_back_by_query(spark, service):
    hits = spark.createDataFrame([(q, c, r, 0.5, "x") for q in (1, 2, 3) for r, c in enumerate("abc")], "query_id int, chunk_id string, rank int, score double, source string")
    bodies = {"a": "lag", "b": "lag lag disk", "c": "lag lag lag disk disk"}
    texts = spark.createDataFrame([(q, c, t, bodies[c]) for q, t in ((1, "lag"), (2, "bad lag"), (3, "disk")) for c in "abc" if (q, c) != (3, "b")], "query_id int, chunk_id string, query string, body string")
    service.refused = "bad"
    scorer = providers.http_reranker(f"{service.url}/rerank", "m", "k")
    out = fusion.rerank(hits.coalesce(1), 3, scorer, texts)
    assert set(out.columns) == set(hits.columns) | {"rerank_score"}
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.rerank_score) for r in out.collect()}
    assert [got[1, i] for i in range(3)] == [("c", 3.0), ("b", 2.0), ("a", 1.0)]
    assert [got[2, i] for i in range(3)] == [("a", None), ("b", None), ("c", None)]
    # A hit without a text is scored as an empty one.
    assert [got[3, i] for i in range(3)] == [("c", 2.0), ("a", 0.0), ("b", 0.0)]
    assert fusion.rerank(hits, 1, scorer, texts).count() == 3 and fusion.rerank(hits.limit(0), 3, scorer, texts.limit(0)).count() == 0

    def broken():
        raise OSError("no model here")

    assert [r.chunk_id for r in fusion.rerank(hits, 2, broken, texts).filter("query_id = 1").orderBy("rank").collect()] == ["a", "b"]


def test_search_reranks(spark, service, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 2)
    ingest(store, docs(spark, *PAGES, ("e", "Other", "## Fix\n\nThe disk, the disk, the disk and again the disk is full, while kafka runs.")))
    section = C.load({"reranking": {"provider": "http", "url": f"{service.url}/rerank", "model": "m", "token": "k"}}, env={}).reranking
    q = spark.createDataFrame([(1, "disk full of logs")], "query_id long, text string")
    titles = {r.chunk_id: r.page_title for r in store.table("chunks").collect()}
    hits = Engine(store, scorer=providers.reranker_of(section)).search(q, top_k=3).orderBy("rank").collect()
    assert titles[hits[0].chunk_id] == "Other" and hits[0].rerank_score == 4.0
    (asked,) = {json.dumps(a) for p, a in service.asked if p == "/rerank"}
    assert json.loads(asked)["query"] == "disk full of logs"


def test_settings_choose(tmp_path):
    assert providers.embedder_of(C.load({}, env={}).embedding) is providers.HASHING and providers.reranker_of(C.load({}, env={}).reranking) is None
    with pytest.raises(ValueError, match="no embedder 'none'; there are hashing, http, sentence"):
        providers.embedder_of(C.Embedding("none"))
    with pytest.raises(ValueError, match="no reranker"):
        providers.reranker_of(C.Reranking("nope"))
    for bad in (C.Embedding("http"), C.Embedding("sentence", model=str(tmp_path / "gone"))):
        with pytest.raises(ValueError):
            providers.embedder_of(bad)
    own = providers.Embedder("own", 3, None, None)
    providers.register_embedder("own", lambda s: own)
    try:
        assert providers.embedder_of(C.Embedding("own")) is own
    finally:
        del providers.EMBEDDERS["own"]
    assert C.load({"embedding": {"token": "x"}}, env={}).summary()["embedding"]["token"] == "***"


def test_model_folders(tmp_path):
    with pytest.raises(ValueError, match="not a folder"):
        providers.check_model_folder(str(tmp_path / "x"))
    with pytest.raises(ValueError, match="config.json and weights .* and a tokenizer"):
        providers.check_model_folder(str(tmp_path))
    (tmp_path / "config.json").write_text('{"hidden_size": 12}')
    (tmp_path / "model.safetensors").write_text("version of a pointer")
    (tmp_path / "tokenizer.json").write_text("{}")
    with pytest.raises(ValueError, match="lacks weights"):
        providers.check_model_folder(str(tmp_path))
    (tmp_path / "model.safetensors").write_bytes(b"0" * 5000)
    assert providers.check_model_folder(str(tmp_path)) == {"hidden_size": 12} and providers.sentence_embedder(str(tmp_path)).width == 12
    assert providers.prompts("/models/bge-small/")[0].startswith("Represent") and providers.prompts("plain") == ("", "")
