"""The content API's data source against a local server."""

import json
import re
import threading
from collections import Counter
from datetime import datetime, timedelta, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlencode, urlsplit

import pytest
from pyspark.sql import functions as F

from runloom.cli import wiki_documents
from runloom.config import Config, Source
from runloom.plans.ingest import ingest
from runloom.plans.store import Store
from runloom.sources import content_api

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


class Wiki:
    """Pages in memory, and a server that understands as much of the search language as the source writes."""

    def __init__(self):
        self.pages, self.asked, self.failures, self.total = {}, [], [], True
        wiki = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                code, out = wiki.answer(self.path, self.headers)
                data = json.dumps(out).encode()
                self.send_response(code)
                if code == 429:
                    self.send_header("Retry-After", "1")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *a):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/wiki"

    def put(self, i, space, created, changed=None, version=1, body="<p>Text of the page.</p>"):
        when = (changed or created).isoformat().replace("+00:00", "Z")
        self.pages[str(i)] = {
            "id": str(i), "title": f"Page {i}", "space": {"key": space}, "version": {"number": version}, "body": {"storage": {"value": body}},
            "history": {"createdDate": created.isoformat(), "lastUpdated": {"when": when}}, "_links": {"webui": f"/p/{i}"},
        }

    def answer(self, path, headers):
        if headers.get("Authorization") != "Bearer t":
            return 401, {}
        if self.failures:
            return self.failures.pop(), {}
        u = urlsplit(path)
        if "/content/search" not in u.path:
            return (200, self.pages[p]) if (p := u.path.rsplit("/", 1)[1]) in self.pages else (404, {})
        a = {k: v[0] for k, v in parse_qs(u.query).items()}
        cql, start, limit = a["cql"], int(a.get("start", 0)), int(a["limit"])
        self.asked.append((cql, start, limit))
        rows = [p for p in self.pages.values() if all(self.holds(p, *c) for c in re.findall(r'(space|id|created|lastmodified) (in|>=|<) (\([^)]*\)|"[^"]*")', cql))]
        rows.sort(key=lambda p: (p["history"]["createdDate"], p["id"]))
        if "lastmodified desc" in cql:
            rows.sort(key=lambda p: p["history"]["lastUpdated"]["when"], reverse=True)
        out = {"results": rows[start : start + limit], "_links": {}} | ({"totalSize": len(rows)} if self.total else {})
        if start + limit < len(rows):
            out["_links"]["next"] = "/rest/api/content/search?" + urlencode(a | {"start": start + limit})
        return 200, out

    @staticmethod
    def holds(p, field, op, value):
        values = re.findall(r'"([^"]*)"', value)
        if op == "in":
            return (p["space"]["key"] if field == "space" else p["id"]) in values
        t = datetime.fromisoformat(p["history"]["createdDate"] if field == "created" else p["history"]["lastUpdated"]["when"])
        bound = datetime.strptime(values[0], "%Y-%m-%d %H:%M").replace(tzinfo=timezone.utc)
        return t >= bound if op == ">=" else t < bound


@pytest.fixture
def wiki():
    w = Wiki()
    yield w
    w.server.shutdown()


def pages(spark, wiki, streaming=False, **options):
    content_api.register(spark)
    reader = spark.readStream if streaming else spark.read
    return reader.format("content_api").options(base_url=wiki.url, token="t", **options).load()


def test_many_pages_are_shared_out(spark, wiki):
    for i in range(330):
        wiki.put(i, "OPS" if i % 3 else "DEV", T0 + timedelta(minutes=i // 2))
    wiki.failures = [429, 503]
    d = pages(spark, wiki, spaces="OPS,DEV", per_partition=40)
    rows = d.select("page_id", "space_key", F.spark_partition_id().alias("p")).collect()
    assert Counter(r.page_id for r in rows) == Counter(str(i) for i in range(330))
    # 220 and 110 pages in partitions of about 40, each of one space, none much larger.
    sizes = Counter(r.p for r in rows)
    assert len(sizes) == 6 + 3 and max(sizes.values()) <= 44 and all(len({r.space_key for r in rows if r.p == p}) == 1 for p in sizes)
    # A server that doesn't tell how many there are is read in one go for each space.
    wiki.total = False
    d = pages(spark, wiki, spaces="OPS,DEV", per_partition=40)
    assert d.count() == 330 and d.rdd.getNumPartitions() == 2


def test_pages_that_come_and_go_during_the_read_move_no_other(spark, wiki):
    for i in range(200):
        wiki.put(i, "OPS", T0 + timedelta(minutes=i))
    client = content_api.Client({"base_url": wiki.url, "token": "t", "per_partition": "50"})
    parts = client.cut(client.query(["OPS"]))
    assert len(parts) == 4
    found = [r["id"] for r in client.results(parts[1])]
    del wiki.pages["10"]
    wiki.put(1000, "OPS", T0 + timedelta(minutes=500))
    for n in (0, 2, 3):
        found += [r["id"] for r in client.results(parts[n])]
    assert sorted(map(int, found)) == [i for i in range(200) if i != 10] + [1000]


def test_filters_reach_the_server(spark, wiki):
    for i in range(60):
        wiki.put(i, "ABC"[i % 3], T0, T0 + timedelta(days=i))
    d = pages(spark, wiki)
    wiki.asked.clear()
    assert {r.page_id for r in d.filter("space_key = 'B' and page_id in ('1', '2', '4')").collect()} == {"1", "4"}
    assert wiki.asked and all('space in ("B")' in c and 'id in ("1", "2", "4")' in c for c, _, _ in wiki.asked)
    assert d.filter("space_key = 'A'").filter("space_key = 'B'").count() == 0
    # Nothing of a space that the source was not given.
    assert pages(spark, wiki, spaces="A,B").filter("space_key = 'C'").count() == 0
    at = T0 + timedelta(days=50)
    wiki.asked.clear()
    assert d.filter(F.col("updated_at") >= F.lit(at)).count() == 10
    assert wiki.asked and all('lastmodified >= "2024-02-19' in c for c, _, _ in wiki.asked)


def test_single_pages_and_refusals(spark, wiki):
    wiki.put(1, "OPS", T0)
    wiki.put(2, "OPS", T0, body="")
    assert [r.page_id for r in pages(spark, wiki, page_id="1").collect()] == ["1"]
    with pytest.raises(Exception, match="page 2 has no body"):
        pages(spark, wiki, page_id="2").collect()
    with pytest.raises(Exception, match="404"):
        pages(spark, wiki, page_id="9").collect()
    assert pages(spark, wiki, spaces="NONE").count() == 0
    # Pages of a search without a body are no pages.
    docs = wiki_documents(spark, Config(source=Source(wiki.url, ["OPS"], token="t")))
    assert [(r.page_id, r.url) for r in docs.collect()] == [("1", f"{wiki.url}/p/1")]


def test_stream_has_each_change_once(spark, wiki, tmp_path):
    for i in range(30):
        wiki.put(i, "OPS", T0 + timedelta(minutes=i))

    def run():
        stream = pages(spark, wiki, streaming=True, spaces="OPS", per_partition=10)
        out = stream.selectExpr("page_id", "get_json_object(value, '$.version.number') v").writeStream.format("parquet")
        q = out.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return Counter((r.page_id, r.v) for r in spark.read.schema("page_id string, v string").parquet(str(tmp_path / "out")).collect())

    want = Counter((str(i), "1") for i in range(30))
    assert run() == want
    wiki.put(4, "OPS", T0, T0 + timedelta(hours=3), 2)
    wiki.put(90, "OPS", T0 + timedelta(hours=4))
    wiki.put(91, "DEV", T0 + timedelta(hours=5))
    want += Counter([("4", "2"), ("90", "1")])
    assert run() == want
    assert run() == want


def test_ingest_from_the_source(spark, wiki, tmp_path):
    for i in range(12):
        wiki.put(i, "OPS", T0 + timedelta(minutes=i), body=f"<h2>Fix</h2><p>Restart number {i}.</p>")
    store, config = Store(spark, str(tmp_path / "s"), buckets=2), Config(source=Source(wiki.url, ["OPS"], token="t"))
    assert ingest(store, wiki_documents(spark, config)).first().changed == 12
    wiki.put(3, "OPS", T0, T0 + timedelta(days=1), 2, "<p>Now another text.</p>")
    r = ingest(store, wiki_documents(spark, config)).first()
    assert (r.seen, r.changed, r.skipped) == (12, 1, 11)
