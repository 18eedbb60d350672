"""A small HTTP front: GET /healthz, GET /v1/stats, POST /v1/search."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .plans.search import Engine

MOST_QUERY, MOST_K = 8000, 50


def answer(engine: Engine, method: str, path: str, body: bytes = b"") -> tuple[int, dict]:
    if (method, path) == ("GET", "/healthz"):
        return 200, {"status": "ok"}
    if (method, path) == ("GET", "/v1/stats"):
        return 200, engine.stats().first().asDict()
    if (method, path) != ("POST", "/v1/search"):
        return 404, {"error": "not found"}
    try:
        r = json.loads(body or b"{}")
        text, k = r["query"], int(r.get("top_k", 0))
        if not isinstance(text, str) or not 1 <= len(text) <= MOST_QUERY or not 0 <= k <= MOST_K:
            raise ValueError("query: 1 to 8000 characters; top_k: 1 to 50")
    except (ValueError, KeyError, TypeError) as e:
        return 422, {"error": str(e)}
    store = engine.store
    wanted = {k: v for k, v in (("space_key", r.get("space")), ("section_kind", r.get("section_kind"))) if v}
    q = store.spark.createDataFrame([(0, text)], "query_id long, text string")
    hits = engine.search(q, wanted, k)
    chunks = store.table("chunks").drop("embed_text")
    found = hits.join(chunks if r.get("include_body", True) else chunks.drop("body_text"), "chunk_id").orderBy("rank")
    out = {"query": text, "chunks": [x.asDict(recursive=True) for x in found.collect()]}
    if r.get("expand", True):
        out["context"] = (engine.context(hits).first() or {"context": ""})["context"]
    return 200, out


def serve(engine: Engine, port: int) -> None:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, method: str) -> None:
            n = int(self.headers.get("Content-Length") or 0)
            code, out = answer(engine, method, self.path, self.rfile.read(n))
            data = json.dumps(out, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._send("GET")

        def do_POST(self) -> None:
            self._send("POST")

    ThreadingHTTPServer(("127.0.0.1", port), Handler).serve_forever()
