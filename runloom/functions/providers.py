"""Providers of embeddings and of rerank scores, chosen by settings.

An ``Embedder`` has a name that goes with each vector, as vectors of different models can't be compared. A scorer serves one
query at a time. Requests are made in the workers, optional libraries load there on first use. ``register_embedder`` and
``register_reranker`` add to what settings can name.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import hashing
from .http import get_json

# What each model family wants before a query and a passage.
PROMPTS = {
    "gemma": ("task: search result | query: ", "title: none | text: "),
    "bge": ("Represent this sentence for searching relevant passages: ", ""),
    "e5": ("query: ", "passage: "),
}
BATCH = 64

Encode = Callable[[list[str]], np.ndarray]
Embed = Callable[[DataFrame, str, str], DataFrame]
Scorer = Callable[[str, list[str]], list[float | None]]


@dataclass(frozen=True)
class Embedder:
    """``documents`` and ``queries`` take (rows, key, text) and return key and ``counts``, the vector."""

    name: str
    width: int
    documents: Embed
    queries: Embed
    #: Whether a vector costs so much that it should not be made twice.
    dear: bool = True


HASHING = Embedder(hashing.NAME, hashing.WIDTH, hashing.embed, hashing.embed, dear=False)


def by_batches(make: Callable[[], Encode], width: int, batch: int = BATCH) -> Embed:
    """``make`` is called once in each task. Null and blank texts have the zero vector and are not sent."""

    def embed(rows: DataFrame, key: str, text: str) -> DataFrame:
        from pyspark.sql.types import StructType

        d = rows.select(key, text)
        schema = StructType([d.schema[key], *StructType.fromDDL("counts array<float>").fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encode = make()
            for b in batches:
                texts = b.column(1).to_pylist()
                sent = [i for i, t in enumerate(texts) if t and t.strip()]
                out = np.zeros((len(texts), width), dtype=np.float32)
                for lo in range(0, len(sent), batch):
                    at = sent[lo : lo + batch]
                    v = encode([texts[i] for i in at])
                    if v.shape != (len(at), width):
                        raise ValueError(f"{len(at)} texts gave vectors of the shape {v.shape}, not of width {width}")
                    out[at] = v
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, width), pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], [key, "counts"])

        return d.mapInArrow(run, schema)

    return embed


def shortened(v: np.ndarray, dimensions: int) -> np.ndarray:
    """The first dimensions, scaled to length one; 0 leaves vectors as they are."""
    if not dimensions:
        return v
    v = v[:, :dimensions]
    return v / (np.sqrt((v * v).sum(axis=1, keepdims=True)) + 1e-12)


def _headers(token: str) -> dict[str, str]:
    return {"Accept": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})


def in_order(rows: list[dict[str, Any]], n: int) -> list[dict[str, Any]]:
    """The rows of an answer by their index; each of 0 to n - 1 has to be there once."""
    rows = sorted(rows, key=lambda r: r["index"])
    if [r["index"] for r in rows] != list(range(n)):
        raise ValueError(f"{n} texts, but the answer has {len(rows)} vectors")
    return rows


def http_encoder(url: str, model: str, token: str, kind: str, dimensions: int = 0) -> Callable[[], Encode]:
    def encode(texts: list[str]) -> np.ndarray:
        answer = get_json(url, _headers(token), data={"input": texts, "model": model, "input_type": kind})
        return shortened(np.array([r["embedding"] for r in in_order(answer["data"], len(texts))], dtype=np.float64), dimensions)

    return lambda: encode


def http_embedder(url: str, model: str, token: str = "", dimensions: int = 0, batch: int = BATCH) -> Embedder:
    """An embedding service that takes and gives JSON. Its width is asked for with one short text."""
    if not url or not model:
        raise ValueError("the provider http needs a url and a model")
    ask = {kind: http_encoder(url, model, token, kind, dimensions) for kind in ("document", "query")}
    width = ask["query"]()(["width"]).shape[1]
    if dimensions and width < dimensions:
        raise ValueError(f"{model} has {width} dimensions, fewer than {dimensions}")
    return Embedder(f"http:{model}:{width}", width, *(by_batches(ask[k], width, batch) for k in ("document", "query")))


def prompts(model: str) -> tuple[str, str]:
    return next((p for family, p in PROMPTS.items() if family in os.path.basename(model.rstrip("/")).lower()), ("", ""))


def check_model_folder(path: str) -> dict[str, Any]:
    """The settings of a whole model folder; says what is missing, and what would help."""
    import json

    if not os.path.isdir(path):
        raise ValueError(f"{path} is not a folder; a model has to be there, as nothing is downloaded")
    names = os.listdir(path)
    lacks = [what for what, there in {
        "config.json": "config.json" in names,
        "weights (*.safetensors or *.bin)": any(n.endswith((".safetensors", ".bin")) and os.path.getsize(os.path.join(path, n)) > 1024 for n in names),
        "a tokenizer (tokenizer.json, tokenizer.model or vocab.txt)": bool({"tokenizer.json", "tokenizer.model", "vocab.txt"} & set(names)),
    }.items() if not there]
    if lacks:
        raise ValueError(f"{path} lacks {' and '.join(lacks)}; copy the whole model folder, with files of large-file storage in place of their pointers")
    with open(os.path.join(path, "config.json"), encoding="utf-8") as f:
        return json.load(f)


def sentence_embedder(path: str, dimensions: int = 0, batch: int = 16) -> Embedder:
    """A sentence-transformers model in a folder that all workers have."""
    width = dimensions or int(check_model_folder(path).get("hidden_size", 0))
    if not width:
        raise ValueError(f"{path}: config.json has no hidden_size; set dimensions")

    def maker(before: str) -> Callable[[], Encode]:
        def make() -> Encode:
            os.environ.setdefault("HF_HUB_OFFLINE", "1")
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as e:
                raise RuntimeError("this embedder needs the package sentence-transformers") from e
            model = SentenceTransformer(path)
            return lambda texts: shortened(model.encode([before + t for t in texts], batch_size=batch, normalize_embeddings=True), dimensions)

        return make

    query, passage = prompts(path)
    return Embedder(f"sentence:{os.path.basename(path.rstrip('/'))}:{width}", width, by_batches(maker(passage), width), by_batches(maker(query), width))


def http_reranker(url: str, model: str, token: str = "") -> Callable[[], Scorer]:
    """A rerank service that takes and gives JSON. Documents that an answer leaves out have no score."""
    if not url or not model:
        raise ValueError("the reranker http needs a url and a model")

    def score(query: str, bodies: list[str]) -> list[float | None]:
        answer = get_json(url, _headers(token), data={"query": query, "documents": bodies, "model": model, "top_k": len(bodies)})
        out: list[float | None] = [None] * len(bodies)
        for r in answer["data"]:
            out[r["index"]] = float(r.get("relevance_score", 0.0))
        return out

    return lambda: score


def cross_encoder(path: str) -> Callable[[], Scorer]:
    check_model_folder(path)

    def make() -> Scorer:
        from sentence_transformers import CrossEncoder

        model = CrossEncoder(path)
        return lambda query, bodies: [float(x) for x in model.predict([(query, b) for b in bodies])]

    return make


#: What settings can name; each takes the section of the settings.
EMBEDDERS: dict[str, Callable[[Any], Embedder]] = {
    "hashing": lambda s: HASHING,
    "http": lambda s: http_embedder(s.url, s.model, s.token, s.dimensions, s.batch or BATCH),
    "sentence": lambda s: sentence_embedder(s.model, s.dimensions, s.batch or 16),
}
RERANKERS: dict[str, Callable[[Any], Callable[[], Scorer] | None]] = {
    "none": lambda s: None,
    "http": lambda s: http_reranker(s.url, s.model, s.token),
    "cross_encoder": lambda s: cross_encoder(s.model),
}


def register_embedder(name: str, make: Callable[[Any], Embedder]) -> None:
    EMBEDDERS[name] = make


def register_reranker(name: str, make: Callable[[Any], Callable[[], Scorer] | None]) -> None:
    RERANKERS[name] = make


def _chosen(known: dict[str, Callable[[Any], Any]], what: str, settings: Any) -> Any:
    if settings.provider not in known:
        raise ValueError(f"no {what} {settings.provider!r}; there are {', '.join(sorted(known))}")
    return known[settings.provider](settings)


def embedder_of(settings: Any) -> Embedder:
    return _chosen(EMBEDDERS, "embedder", settings)


def reranker_of(settings: Any) -> Callable[[], Scorer] | None:
    return _chosen(RERANKERS, "reranker", settings)
