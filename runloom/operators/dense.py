"""Exact vector search over batches of queries.

Query vectors go out in blocks of QUERY_BLOCK rows, a bound on each broadcast; each
task keeps the k best of its rows, and only these are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.memory import release, small_batches
from .lexical import ranked

QUERY_BLOCK = 4096
#: Queries and rows whose products are made at once in a task.
QUERY_TILE, ROW_TILE = 256, 1024


def cosine_score(cos: np.ndarray) -> np.ndarray:
    """Cosine as a similarity from 0 to 1."""
    return np.maximum(0.0, (1.0 + cos) / 2.0)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x, np.sqrt((x * x).sum(axis=1))


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there, not empty, and without null or non-finite components."""
    v = F.col(vector)
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return rows.filter(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, odd))


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 30, vector: str = "embedding", metric: str = "cosine") -> DataFrame:
    """query_id, vector; chunk_id, vector -> query_id, chunk_id, score, rank. The filter on rows comes before."""
    spark = vectors.sparkSession
    small_batches(spark)
    q = usable(queries.select("query_id", vector), vector)
    n, width = q.agg(F.count(F.lit(1)), F.mode(F.size(vector), deterministic=True)).first()
    # Vectors of another length than the queries' can't be compared with them.
    q, vectors = q.filter(F.size(vector) == F.lit(width)), usable(vectors, vector).filter(F.size(vector) == F.lit(width))
    id_type, doc_type = q.schema["query_id"].dataType.simpleString(), vectors.schema["chunk_id"].dataType.simpleString()
    schema = f"query_id {id_type}, chunk_id {doc_type}, score double"
    if n <= QUERY_BLOCK:
        blocks = [q.toArrow()]
    else:
        parts = -(-2 * n // QUERY_BLOCK)
        numbered = q.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
        blocks = [numbered.filter(F.col("_b") == i).drop("_b").toArrow() for i in range(parts)]
    out = None
    for block in blocks:
        if not block.num_rows:
            continue
        shared = spark.sparkContext.broadcast((block.column(0).to_pylist(), np.array(block.column(1).to_pylist(), dtype=np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, (qx, qn) = shared.value[0], _unit(shared.value[1])
            found: list[list[tuple]] = [[] for _ in ids]
            for b in batches:
                for lo in range(0, len(b), ROW_TILE):
                    part = b.slice(lo, ROW_TILE)
                    chunk = part.column(0).to_pylist()
                    x, xn = _unit(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1))
                    for first in range(0, len(ids), QUERY_TILE):
                        q = slice(first, first + QUERY_TILE)
                        s = qx[q] @ x.T
                        if metric == "cosine":
                            size = np.outer(qn[q], xn)
                            s = cosine_score(np.divide(s, size, out=np.zeros_like(s), where=size > 0))
                        # Rows near the k-th score stay, so that ties by the rounded score are settled below.
                        least = np.partition(s, -k, axis=1)[:, -k] - 1e-9 if s.shape[1] > k else np.full(len(s), -np.inf)
                        r, c = np.nonzero(s >= least[:, None])
                        for i, j, v in zip((r + first).tolist(), c.tolist(), s[r, c].tolist()):
                            found[i].append((-round(v, 9), chunk[j], v))
                        for i in range(first, min(first + QUERY_TILE, len(ids))):
                            found[i] = sorted(found[i])[: max(1, k)]
            rows = [(ids[i], c, v) for i, f in enumerate(found) for _, c, v in f]
            for i in range(0, len(rows), 50_000):
                part = pa.Table.from_pylist([dict(zip(("query_id", "chunk_id", "score"), r)) for r in rows[i : i + 50_000]])
                yield from part.to_batches()
            release()

        found = vectors.select("chunk_id", vector).mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return ranked(out, k)


def merge_variants(hits: DataFrame, k: int) -> DataFrame:
    """Hits of several variants of a query -> its k best chunks by their best score."""
    return ranked(hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), k)
