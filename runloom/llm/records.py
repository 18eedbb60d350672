"""Token-id records in a length-delimited binary format.

A record file is a sequence of frames, each
    length (u64) | masked CRC-32 of the length (u32) | payload | masked CRC-32 of the payload (u32)
little-endian throughout. A payload is: bytes of a token id (u8, 2 or 4 by the
vocabulary's size), has-id flag (u8), id (i64), then token ids.
Beside each ``part-*.rec`` stands ``part-*.idx``: the u64 offset of each frame, so
that a reader can fetch records in any order.

Writing: documents are dealt by ranges of doc_id and sorted inside them; a task
writes one file of its own to the shared folder under a name that no other attempt has,
closes it, and only then reports it. The files of successful attempts make up the
manifest (``manifest.parquet``, one row a file), so attempts that failed
or ran twice leave no trace in it. Reading goes by the manifest, one task a
file, checks both checksums of each record and fails on any damage.

Cases: a null text is an empty text and yields the end id alone. Null ids come
first. Repeated rows are records of their own. An empty table gives no records.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import partitions as partitions_of, release, scratch, small_batches
from .tokens import CACHE, KEPT, encoder, id_type, slices

END = 0


def masked(crc: int) -> int:
    """Rotated and offset, so that a checksum of data that holds checksums stays sound."""
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(zlib.crc32(head))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return struct.pack("<BBq", width, doc_id is not None, doc_id or 0) + ids


def unpacked(body: memoryview) -> tuple[int | None, np.ndarray]:
    """The id and the token ids (u32) of a payload."""
    width, has, doc_id = struct.unpack_from("<BBq", body)
    return doc_id if has else None, np.frombuffer(body, dtype=f"<u{width}", offset=10).astype("<u4")


def read_frames(data: memoryview, offsets: np.ndarray | None = None) -> Iterator[memoryview]:
    """Payloads at the offsets (all in order, if none are given); damage raises ValueError."""
    at, k = 0, 0
    while (at < len(data)) if offsets is None else (k < len(offsets)):
        if offsets is not None:
            at = int(offsets[k])
            k += 1
        n, c = struct.unpack_from("<QI", data, at)
        if masked(zlib.crc32(bytes(data[at : at + 8]))) != c or at + 16 + n > len(data):
            raise ValueError(f"damaged length at byte {at}")
        body = data[at + 12 : at + 12 + n]
        if masked(zlib.crc32(bytes(body))) != struct.unpack_from("<I", data, at + 12 + n)[0]:
            raise ValueError(f"damaged record at byte {at}")
        yield body
        at += 16 + n


def _open(path: str):
    """A file system for a URI of the shared folder (file, hdfs, s3, gs), and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def write_records(docs: DataFrame, path: str, tokenizer: str, end: int = END, partitions: int | None = None, keep_cache: bool = False) -> DataFrame:
    """Encode doc_id, text and write them below ``path``; returns the manifest (file, part, n, n_tokens).

    ``keep_cache``: a worker's next task uses the words that its last one met, at KEPT bytes a worker.
    """
    spark = docs.sparkSession
    n = partitions or partitions_of(docs)
    small_batches(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Rows that share an id are told apart by their text, so that no id fills a range of its own.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    d = d.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    fs_, root = _open(path)
    fs_.create_dir(root, recursive=True)
    dtype = id_type(tokenizer)
    last = np.array([end], dtype=dtype).tobytes()
    width = len(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        store, top = _open(path)
        store.create_dir(top, recursive=True)  # a new executor may come before any other
        enc = encoder(tokenizer, dtype, KEPT if keep_cache else CACHE)
        count = tokens = at = 0
        offsets = []
        with store.open_output_stream(f"{top}/{name}.rec") as out:
            for b in batches:
                ids, text = b.column(0), b.column(1)
                for s in slices(pa.compute.binary_length(text).to_pylist()):
                    part_ids = ids[s.start : s.stop].to_pylist()
                    for i, e in zip(part_ids, enc.ids(text[s.start : s.stop].to_pylist())):
                        f = frame(payload(i, e + last, width))
                        offsets.append(at)
                        out.write(f)
                        at += len(f)
                        count += 1
                        tokens += len(e) // width + 1
        if not keep_cache:
            enc.clear()
        release()
        with store.open_output_stream(f"{top}/{name}.idx") as out:
            out.write(np.array(offsets, dtype="<u8").tobytes())
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([count], pa.int64()), pa.array([tokens], pa.int64())], ["file", "part", "n", "n_tokens"])

    d.mapInArrow(run, "file string, part int, n long, n_tokens long").write.parquet(f"{path}/manifest.parquet")
    return spark.read.parquet(f"{path}/manifest.parquet")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each record, in parallel by file."""
    files = spark.read.parquet(f"{path}/manifest.parquet")
    # One row a file; starts are sums over the files before.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("start"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(path)
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                offsets = np.frombuffer(store.open_input_file(f"{top}/{file}.idx").read(), dtype="<u8")
                rows = []
                for body in read_file(store, f"{top}/{file}.rec", offsets):
                    doc_id, ids = unpacked(body)
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(rows) == 20_000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    return files.repartition(n, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_file(store, path: str, offsets: np.ndarray, window: int = 8_000_000) -> Iterator[memoryview]:
    """Records of one file, a window of it in memory at a time."""
    with store.open_input_file(path) as f:
        size = f.size()
        ends = np.append(offsets[1:], np.uint64(size)).astype(np.int64) if len(offsets) else np.array([], dtype=np.int64)
        i = 0
        while i < len(offsets):
            j = max(i + 1, int(np.searchsorted(ends, int(offsets[i]) + window)))
            f.seek(int(offsets[i]))
            data = memoryview(f.read(int(ends[j - 1]) - int(offsets[i])))
            yield from read_frames(data, offsets[i:j].astype(np.int64) - int(offsets[i]))
            i = j


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_records(docs: DataFrame, tokenizer: str, end: int = END, keep_cache: bool = False) -> DataFrame:
    """Write to a fresh folder below the shared one, and read back."""
    path = scratch(docs.sparkSession, "records")
    write_records(docs, path, tokenizer, end, keep_cache=keep_cache)
    return read_records(docs.sparkSession, path)
