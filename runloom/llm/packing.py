"""Packing along a space-filling curve.

1. Texts become token ids; from these, hashed counts, which a fixed random projection
   takes to DIMS dimensions. Normalised coordinates are cut into 2^BITS steps and give
   a Hilbert key: documents of similar content lie near each other on the curve.
2. Ids and keys are checkpointed, so that nothing is encoded twice. Tokens are counted by
   CELLS cells of the curve; the cells in order are cut into ranges of equal tokens, a cell at
   a cut by its documents' hashes. Rows are sorted along the curve inside a range.
3. Each range is one stream of documents, cut into sequences of LENGTH tokens. What
   is left at its end is cut into sequences whose lengths are powers of two, which need no padding.
   So a document is only cut where a sequence ends, and no token is padding.

A range's sequence ids begin at range << 40. Copies share a key, and so a cell; the hash of
id and tokens spreads them over ranges, however many there are.

Cases: a null text is an empty one: its end id alone. Null ids sort first. Repeated
rows are packed each; ties in key and hash go by the id, then by the token ids. A very long text is cut
where sequences end, like any other. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import checkpoint, release, small_batches
from .tokens import CACHE, KEPT, encoder, slices

LENGTH = 2048
END = 1
DIMS = 4
BITS = 8
#: Token ids are hashed into so many counts before the projection.
BINS = 1 << 12
#: Cells of the curve, by the key's first bits, and about how many tokens a range has where they are many.
CELL_BITS, RANGE = 12, 1 << 26
#: Pieces that leave together, 4 MB of ids.
PIECES = 500


@lru_cache(maxsize=2)
def projection(seed: int = 7) -> np.ndarray:
    """Row of each token bin in DIMS dimensions."""
    return np.random.default_rng(seed).standard_normal((BINS, DIMS)).astype(np.float32)


def project(ids: np.ndarray) -> np.ndarray:
    """Mean-free direction of one document: log counts of its token bins, projected to the sphere."""
    counts = np.bincount((ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(20), minlength=BINS)
    at = np.flatnonzero(counts)
    v = np.log1p(counts[at]) @ projection()[at]
    n = float(np.sqrt((v * v).sum()))
    return v / n if n > 0 else np.zeros(DIMS)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (n, dims), 0 <= coordinate < 2^bits.

    The coordinates are turned into the curve's transposed index by undoing, from the
    highest bit down, the reflections and exchanges of each level; Gray coding follows.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(dims):
            high = (x[i] >> level) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def keys(vectors: np.ndarray) -> np.ndarray:
    steps = np.clip(np.floor((vectors + 1) / 2 * (1 << BITS)), 0, (1 << BITS) - 1)
    return hilbert(steps)


def encoded(docs: DataFrame, tokenizer: str, end: int = END, keep_cache: bool = False) -> DataFrame:
    """doc_id, text -> doc_id, key, ids (u16, the end id included; the encoder refuses a vocabulary that they can't hold)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, "<u2", KEPT if keep_cache else CACHE)
        last = np.array([end], dtype="<u2").tobytes()
        for b in batches:
            text = b.column(1)
            for s in slices(pa.compute.binary_length(text).to_pylist()):
                ids = enc.ids(text[s.start : s.stop].to_pylist())
                at = keys(np.array([project(np.frombuffer(i, dtype="<u2")) for i in ids]))
                yield pa.RecordBatch.from_arrays([b.column(0)[s.start : s.stop], pa.array(at, pa.int64()), pa.array([i + last for i in ids], pa.binary())], ["doc_id", "key", "ids"])
        if not keep_cache:
            enc.clear()
        release()

    return d.mapInArrow(run, "doc_id long, key long, ids binary")


def cuts(total: int, length: int = LENGTH) -> list[int]:
    """Lengths of the sequences of a stream: full ones, then powers of two."""
    rest = total % length
    return [length] * (total // length) + [1 << k for k in range(length.bit_length() - 1, -1, -1) if rest >> k & 1]


def ranged(d: DataFrame, parts: int | None = None) -> DataFrame:
    """key, ids, ... -> the same, one partition for each range of the curve, about equal in tokens, in the curve's order."""
    share = F.xxhash64("doc_id", "ids")
    d = d.withColumn("cell", F.shiftright("key", DIMS * BITS - CELL_BITS).cast("int"))
    # 2^CELL_BITS rows at most.
    cells = checkpoint(d.groupBy("cell").agg(F.sum(F.octet_length("ids")).alias("size")))
    total = cells.agg(F.sum("size")).first()[0] or 1
    n = parts or max(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (2 * RANGE)))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("cell", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    at = F.col("first") + F.col("size") * F.pmod(share, F.lit(1 << 30)) / float(1 << 30)
    d = d.join(F.broadcast(cells), "cell").withColumn("range", F.least(F.floor(at * n / total), F.lit(n - 1)).cast("int"))
    return d.select("doc_id", "key", "ids", "range").repartitionById(n, "range").sortWithinPartitions("key", share, F.col("doc_id").asc_nulls_first(), "ids")


def pack(docs: DataFrame, tokenizer: str, end: int = END, length: int = LENGTH, partitions: int | None = None, keep_cache: bool = False) -> DataFrame:
    """doc_id, text -> pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``keep_cache``: a worker's next task uses the words that its last one met, at KEPT bytes a worker, which idle beside other work.
    """
    d = ranged(checkpoint(encoded(docs, tokenizer, end, keep_cache)), partitions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        # The last sequence is open until the stream ends: its pieces are held, LENGTH tokens at most.
        held: list[tuple] = []
        seq, fill = first, 0
        for b in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(b.column(0).to_pylist(), b.column(2)):
                x = np.frombuffer(ids.as_buffer(), dtype="<u2").astype("<u4")
                at = 0
                while at < len(x):
                    take = min(length - fill, len(x) - at)
                    held.append((doc_id, at, x[at : at + take], len(x), seq, fill))
                    at, fill = at + take, fill + take
                    if fill == length:
                        rows += held
                        held, seq, fill = [], seq + 1, 0
                if len(rows) > PIECES:
                    yield _pieces(rows)
                    rows = []
            yield _pieces(rows)
        rows = []
        for doc_id, start, x, total, _, at in held:
            edge = 0
            for k, size in enumerate(cuts(fill, length)):
                lo, hi = max(at, edge), min(at + len(x), edge + size)
                if lo < hi:
                    rows.append((doc_id, start + lo - at, x[lo - at : hi - at], total, seq + k, lo - edge))
                edge += size
        yield _pieces(rows)

    return d.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    raw = [r[2].tobytes() for r in rows]
    long = lambda v: pa.array(v, pa.int64())
    return pa.RecordBatch.from_arrays(
        [long([r[0] for r in rows]), long([r[1] for r in rows]), long([len(x) // 4 for x in raw]), long([zlib.crc32(x) for x in raw]), long([r[3] for r in rows]), long([r[4] for r in rows]), long([r[5] for r in rows]), pa.array(raw, pa.binary())],
        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
    )
