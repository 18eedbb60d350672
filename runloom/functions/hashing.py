"""The hashing embedder: signed counts of hashed words and word pairs, scaled to length one.

Counts are integers until the last step, so that cosines don't depend on the
order of summation. ``counts`` is the Catalyst form; ``embed`` the Arrow form for bulk.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .memory import release, small_batches

WIDTH = 384
#: Words and pairs whose places a worker keeps, and texts that are counted at once.
KEPT, TEXTS = 100_000, 1024
NAME = "hashing-384"
_WORD = re.compile(r"[a-z0-9_]+")


def grams(text: Column) -> Column:
    w = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))
    pairs = F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("_"), b))
    return F.concat(w, F.filter(pairs, lambda p: p.isNotNull()))


def slot(gram: Column) -> Column:
    """(index, sign): the first four digest bytes, little-endian, and the fifth one's parity."""
    h = F.md5(gram.cast("binary"))
    word = F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])
    sign = F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    return F.struct((F.conv(word, 16, 10).cast("long") % WIDTH).cast("int").alias("idx"), sign.alias("sign"))


def counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, text -> key, idx, n: the non-zero counts, by DataFrame operations."""
    g = rows.select(key, F.explode(grams(F.col(text))).alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("_times"))
    s = g.select(key, slot(F.col("gram")).alias("_slot"), "_times")
    return s.groupBy(key, F.col("_slot.idx").alias("idx")).agg(F.sum(F.col("_slot.sign") * F.col("_times")).alias("n")).filter("n <> 0")


def count_vector(text: str | None, cache: dict[str, tuple[int, int]]) -> np.ndarray:
    out = np.zeros(WIDTH)
    w = _WORD.findall((text or "").lower())
    for g in [*w, *map("_".join, zip(w, w[1:]))]:
        at = cache.get(g)
        if at is None:
            d = hashlib.md5(g.encode()).digest()
            at = cache[g] = (int.from_bytes(d[:4], "little") % WIDTH, 1 if d[4] % 2 == 0 else -1)
            if len(cache) > KEPT:
                cache.clear()
        out[at[0]] += at[1]
    return out


def embed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, text -> key, counts (array of int)."""
    from pyspark.sql.types import StructType

    small_batches(rows.sparkSession)
    d = rows.select(key, text)
    schema = StructType([d.schema[key], *StructType.fromDDL("counts array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, int]] = {}
        for whole in batches:
            for lo in range(0, len(whole), TEXTS):
                b = whole.slice(lo, TEXTS)
                flat = np.zeros((len(b), WIDTH), dtype=np.int32)
                for i, t in enumerate(b.column(1)):
                    flat[i] = count_vector(t.as_py(), cache)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, WIDTH), pa.int32()), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], [key, "counts"])
        cache.clear()
        release()

    return d.mapInArrow(run, schema)


def unit(count: Column) -> Column:
    """Counts scaled to length one; zero stays zero."""
    norm = F.sqrt(F.aggregate(count, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(count, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)).cast("float"))
