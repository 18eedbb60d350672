"""Inverted-file vector index: trained centroids, rows filed by cell with residual codes, exact reranking.

``train`` fits centroids by spherical k-means on a bounded sample, and measures how many cells a query has to visit: the
exact neighbours of TRIALS rows are found by one pass over all rows, and ``probes`` is the least number of
cells that holds the share HOLD of them. ``filed`` gives each row its cell and one byte for each component of what the
centroid leaves over, so that new rows are filed as they come. ``search`` reads the cells that its queries visit (a filter
on ``cell`` that reaches the scan), scores codes, and reranks REFINE * k candidates of each query by their own vectors.

Vectors of another length than the centroids', null ones and such with null or non-finite components are filed nowhere and never found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .dense import QUERY_BLOCK, QUERY_TILE, dense_topk, usable
from .lexical import ranked

SAMPLE, SAMPLE_BYTES = 65_536, 64 << 20
CELLS = 4096
TRIALS, HOLD = 128, 0.95
REFINE = 8
#: Candidates that a task holds for each query before it drops all but the best.
HELD = 4


@dataclass
class Index:
    """CELLS centroids at most, of length one, and the number of cells that a query visits."""

    centroids: np.ndarray
    probes: int
    rows: int

    def near(self, q: np.ndarray, n: int | None = None) -> np.ndarray:
        """The cells of each query, nearest first."""
        n = min(n or self.probes, len(self.centroids))
        s = -(q @ self.centroids.T)
        if n < s.shape[1]:
            part = np.argpartition(s, n - 1, axis=1)[:, :n]
        else:
            part = np.tile(np.arange(s.shape[1]), (len(q), 1))
        return np.take_along_axis(part, np.argsort(np.take_along_axis(s, part, axis=1), axis=1, kind="stable"), axis=1)


def save(spark: SparkSession, index: Index, path: str) -> None:
    rows = [(i, [float(v) for v in c], index.probes, index.rows) for i, c in enumerate(index.centroids)]
    spark.createDataFrame(rows, "cell int, centroid array<float>, probes int, rows long").coalesce(1).write.parquet(path)


def load(spark: SparkSession, path: str) -> Index:
    rows = spark.read.parquet(path).orderBy("cell").collect()  # CELLS at most
    return Index(np.array([r["centroid"] for r in rows], dtype=np.float64), rows[0]["probes"], rows[0]["rows"])


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of unit length; a zero vector stays zero."""
    x = col.values.to_numpy(zero_copy_only=False).astype(np.float64)
    at = col.offsets.to_numpy()
    x = x[at[0] : at[-1]].reshape(len(col), -1)
    size = np.sqrt((x * x).sum(axis=1))
    return x / np.where(size > 0, size, 1)[:, None]


def kmeans(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Directions of cluster centres; a centre that loses all its points takes the place of a point far from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), cells, replace=False)].copy()
    for _ in range(rounds):
        near, score = assigned(x, c)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.sqrt((total * total).sum(axis=1))
        c = total / np.where(size > 0, size, 1)[:, None]
        lost = np.flatnonzero(size == 0)
        c[lost] = x[np.argsort(score)[: len(lost)]]
    return c


def assigned(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near, score = np.empty(len(x), np.int64), np.empty(len(x))
    for i in range(0, len(x), 4096):
        s = x[i : i + 4096] @ c.T
        near[i : i + 4096] = s.argmax(axis=1)
        score[i : i + 4096] = s.max(axis=1)
    return near, score


def train(vectors: DataFrame, vector: str = "embedding", cells: int | None = None, probes: int | None = None, k: int = 10, hold: float = HOLD) -> Index | None:
    """chunk_id, vector -> an index; None where there are no usable vectors."""
    v = usable(vectors.select("chunk_id", vector), vector)
    n, width = v.agg(F.count(F.lit(1)), F.mode(F.size(vector), deterministic=True)).first()
    if not n:
        return None
    v = v.filter(F.size(vector) == width)
    most = max(256, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    drawn = v.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(most).select(F.col(vector).cast("array<double>").alias("x")).toArrow()
    x = matrix(drawn.column(0).combine_chunks())
    cells = cells or int(np.clip(4 * np.sqrt(n), 1, min(CELLS, max(1, len(x) // 16))))
    index = Index(kmeans(x, min(cells, len(x))), 1, n)
    index.probes = probes or measured(v, vector, index, k, hold)
    return index


def measured(v: DataFrame, vector: str, index: Index, k: int, hold: float) -> int:
    """The least number of cells in which TRIALS rows of the table find the share ``hold`` of their exact neighbours."""
    cells = len(index.centroids)
    if cells == 1:
        return 1
    asked = v.orderBy(F.xxhash64("chunk_id", F.lit(1)), "chunk_id").limit(TRIALS).select(F.col("chunk_id").alias("query_id"), vector)
    pairs = dense_topk(asked, v, k + 1, vector).filter("query_id <> chunk_id").join(v, "chunk_id").join(asked.withColumnRenamed(vector, "_q"), "query_id")
    t = pairs.select(F.col("_q").cast("array<double>").alias("q"), F.col(vector).cast("array<double>").alias("x")).toArrow()  # TRIALS * k rows
    if not t.num_rows:
        return 1
    home = assigned(matrix(t.column(1).combine_chunks()), index.centroids)[0]
    order = index.near(matrix(t.column(0).combine_chunks()), cells)
    place = np.sort((order == home[:, None]).argmax(axis=1) + 1)
    return int(place[min(len(place) - 1, int(np.ceil(hold * len(place))) - 1)])


def filed(rows: DataFrame, index: Index, vector: str = "embedding") -> DataFrame:
    """The rows with ``cell``, ``code`` and ``scale``; those that can't be searched have nulls there."""
    spark, width = rows.sparkSession, index.centroids.shape[1]
    shared = spark.sparkContext.broadcast(index.centroids)
    good = usable(rows.withColumn("_n", F.size(vector)), vector).filter(F.col("_n") == width).drop("_n")
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("cell int, code binary, scale float").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = matrix(b.column(b.schema.get_field_index(vector)))
            cell = assigned(x, shared.value)[0]
            rest = x - shared.value[cell]
            scale = np.abs(rest).max(axis=1) / 127
            code = np.rint(rest / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale.astype(np.float32))], schema.fieldNames())

    return good.mapInArrow(run, schema)


def visited(queries: DataFrame, index: Index, vector: str = "embedding") -> list[tuple[list, np.ndarray, np.ndarray]]:
    """Queries in blocks of QUERY_BLOCK: ids, unit vectors, cells of each."""
    q = usable(queries.select("query_id", vector), vector).filter(F.size(vector) == index.centroids.shape[1])
    parts = max(1, -(-2 * q.count() // QUERY_BLOCK)) if q.count() > QUERY_BLOCK else 1
    numbered = q.select("query_id", F.col(vector).cast("array<double>").alias("x"), F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("_b"))
    out = []
    for i in range(parts):
        t = numbered.filter(F.col("_b") == i).toArrow()
        if t.num_rows:
            x = matrix(t.column(1).combine_chunks())
            out.append((t.column(0).to_pylist(), x, index.near(x)))
    return out


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, p: s + p)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def search(queries: DataFrame, rows: DataFrame, index: Index, k: int = 30, vector: str = "embedding") -> DataFrame:
    """query_id, vector; filed rows -> query_id, chunk_id, score, rank. Scores are exact, as in ``dense_topk``."""
    spark, most = rows.sparkSession, REFINE * max(1, k)
    id_type, doc_type = queries.schema["query_id"].dataType.simpleString(), rows.schema["chunk_id"].dataType.simpleString()
    found = None
    for ids, x, cells in visited(queries, index, vector):
        used = np.unique(cells)
        shared = spark.sparkContext.broadcast((ids, x, x @ index.centroids.T, {int(c): np.flatnonzero((cells == c).any(axis=1)) for c in used}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, x, base, askers = shared.value
            held: list[list] = []
            size = 0

            def best() -> tuple[np.ndarray, np.ndarray, list]:
                q, s = (np.concatenate([h[i] for h in held]) for i in (0, 1))
                names = [n for h in held for n in h[2]]
                order = np.lexsort((-s, q))
                place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
                keep = order[place < most]
                return q[keep], s[keep], [names[i] for i in keep.tolist()]

            for b in batches:
                cell = b.column(1).to_numpy()
                names, scale = b.column(0).to_pylist(), b.column(3).to_numpy()
                for c in np.unique(cell).tolist():
                    who = askers.get(c)
                    if who is None:
                        continue
                    at = np.flatnonzero(cell == c)
                    code = np.frombuffer(b"".join(b.column(2).take(pa.array(at)).to_pylist()), np.int8).reshape(len(at), -1).astype(np.float64)
                    for i in range(0, len(who), QUERY_TILE):
                        w = who[i : i + QUERY_TILE]
                        s = base[w, c][:, None] + (x[w] @ code.T) * scale[at][None, :]
                        if s.shape[1] > most:
                            near = np.argpartition(-s, most - 1, axis=1)[:, :most]
                            s = np.take_along_axis(s, near, axis=1)
                        else:
                            near = np.tile(np.arange(s.shape[1]), (len(w), 1))
                        held.append([np.repeat(w, s.shape[1]), s.ravel(), [names[j] for j in at[near.ravel()].tolist()]])
                        size += s.size
                        if size > HELD * most * len(ids) + 100_000:
                            held = [list(best())]
                            size = len(held[0][0])
            if held:
                q, s, names = best()
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q.tolist()], type_of["query_id"]), pa.array(names, type_of["chunk_id"]), pa.array(s)], ["query_id", "chunk_id", "score"])

        from pyspark.sql.pandas.types import to_arrow_type

        type_of = {"query_id": to_arrow_type(queries.schema["query_id"].dataType), "chunk_id": to_arrow_type(rows.schema["chunk_id"].dataType)}
        some = rows if len(used) == len(index.centroids) else rows.filter(F.col("cell").isin([int(c) for c in used]))
        near = some.select("chunk_id", "cell", "code", "scale").mapInArrow(run, f"query_id {id_type}, chunk_id {doc_type}, score double")
        near = ranked(near, most).select("query_id", "chunk_id").join(some.select("chunk_id", vector), "chunk_id")
        found = near if found is None else found.unionByName(near)
    if found is None:
        return ranked(spark.createDataFrame([], f"query_id {id_type}, chunk_id {doc_type}, score double"), k)
    exact = found.join(queries.select("query_id", F.col(vector).alias("_q")), "query_id")
    score = F.greatest(F.lit(0.0), (1 + cosine(F.col("_q"), F.col(vector))) / 2)
    return ranked(exact.select("query_id", "chunk_id", score.alias("score")), k)
