"""Packing into as few sequences as possible: best fit, then a local search by swaps.

1. Texts become token ids. A document of up to LENGTH tokens is one piece; a longer one is cut into pieces of LENGTH tokens,
   the first of which takes what is over. Pieces are written once, and from then on only their sizes are read.
2. Pieces shorter than a sequence are dealt by a hash into groups of about GROUP tokens (and ITEMS pieces at most, about). Groups are
   alike, and each costs less than one sequence more than a whole packing would: under one in 2,048.
3. In a group, pieces go by falling size into the fullest bin that has room. The local search follows, over bins that are not
   full: from the fullest on, a bin takes in what makes it fullest from a bin that is less full than itself. It moves a piece, or exchanges one for one, two
   for one, or one for two. Each such step increases the sum of squared fills, so the search ends; bins that lose all their
   pieces go. It stops early where no packing could have fewer bins.

Cases: a null text is an empty one: its end id alone. Null ids are ids like any other, repeated rows are packed each. Ties in
size go by the pieces' numbers, so equal input in equal partitions gives equal bins. A very long text becomes many full pieces and one rest. An
empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import release, scratch, small_batches
from .tokens import CACHE, KEPT, encoder, id_type, slices

LENGTH = 1024
END = 2
GROUP, ITEMS = 1 << 21, 1 << 17


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Items by falling size, each into the fullest bin with room for it: lists of item numbers."""
    bins, open_, free = [], [[] for _ in range(length + 1)], 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fits = free >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = open_[left].pop()
            if not open_[left]:
                free &= ~(1 << left)
        else:
            b, left = len(bins), length
            bins.append([])
        bins[b].append(i)
        left -= size
        if left:
            open_[left].append(b)
            free |= 1 << left
    return bins


class _Pool:
    """Which sizes, and sums of two sizes of one bin, the later bins have to give; as bits, and where."""

    def __init__(self) -> None:
        self.bits = [0, 0]
        self.where: tuple[dict, dict] = ({}, {})

    @staticmethod
    def offers(bin_: Counter) -> tuple[set[int], set[int]]:
        ones = sorted(bin_)
        return set(ones), {a + b for i, a in enumerate(ones) for b in ones[i:] if a != b or bin_[a] > 1}

    def change(self, place: int, offers: tuple[set[int], set[int]], add: bool) -> None:
        for kind, sums in enumerate(offers):
            for s in sums:
                at = self.where[kind].setdefault(s, set())
                if add:
                    at.add(place)
                    self.bits[kind] |= 1 << s
                else:
                    at.discard(place)
                    if not at:
                        self.bits[kind] &= ~(1 << s)

    def greatest(self, kind: int, least: int, most: int) -> int:
        """The greatest sum on offer from least to most, or 0."""
        bits = (self.bits[kind] & ((1 << (most + 1)) - 1)) >> least << least
        return bits.bit_length() - 1 if bits else 0


def improve(bins: list[list[int]], sizes: list[int], length: int) -> list[list[int]]:
    """Swap-based local search: the same items in as many bins or fewer."""
    total = sum(sizes)
    while len(bins) > -(-total // length):
        bins, stepped = _round(bins, sizes, length)
        if not stepped:
            break
    return bins


def _round(bins: list[list[int]], sizes: list[int], length: int) -> tuple[list[list[int]], bool]:
    full = [b for b in bins if sum(sizes[i] for i in b) == length]
    rest = sorted((b for b in bins if sum(sizes[i] for i in b) < length), key=lambda b: (-sum(sizes[i] for i in b), b[0]))
    items: list[dict[int, list[int]]] = []
    for b in rest:
        by: dict[int, list[int]] = {}
        for i in b:
            by.setdefault(sizes[i], []).append(i)
        items.append(by)
    have = [Counter({s: len(v) for s, v in by.items()}) for by in items]
    fill = [sum(s * n for s, n in h.items()) for h in have]
    pool, stepped = _Pool(), False
    offers = [_Pool.offers(h) for h in have]
    for place, o in enumerate(offers):
        pool.change(place, o, True)
    for place in range(len(rest)):
        pool.change(place, offers[place], False)
        while fill[place] < length:
            room, step = length - fill[place], None
            own, pairs = _Pool.offers(have[place])
            # What goes out (nothing, one, or two pieces), and what comes in (one, or two of one bin).
            for out, kind in [(0, 0), *((x, 0) for x in own), *((x, 0) for x in pairs), *((x, 1) for x in own)]:
                got = pool.greatest(kind, out + 1, min(length, out + room))
                if got and (step is None or got - out > step[0]):
                    step = (got - out, out, kind, got, out in pairs and out not in own)
                    if step[0] == room:
                        break
            if step is None:
                break
            gain, out, kind, got, two = step
            # Of the bins that have it, the least full, so that bins empty.
            giver = min(pool.where[kind][got], key=lambda p: (fill[p], p))
            leaving = _pair(have[place], out) if two else (out,) if out else ()
            coming = _pair(have[giver], got) if kind else (got,)
            pool.change(giver, offers[giver], False)
            for a, b, moved in ((giver, place, coming), (place, giver, leaving)):
                for s in moved:
                    items[b].setdefault(s, []).append(items[a][s].pop())
                    have[b][s] += 1
                    have[a][s] -= 1
                    if not have[a][s]:
                        del have[a][s]
            fill[place] += gain
            fill[giver] -= gain
            offers[giver] = _Pool.offers(have[giver])
            pool.change(giver, offers[giver], True)
            stepped = True
    return full + [b for b in ([i for v in by.values() for i in v] for by in items) if b], stepped


def _pair(have: Counter, total: int) -> tuple[int, int]:
    return next((a, total - a) for a in sorted(have) if total - a in have and (2 * a != total or have[a] > 1))


def packed(sizes: list[int], length: int = LENGTH) -> list[list[int]]:
    """Item numbers of each bin."""
    return improve(best_fit(sizes, length), sizes, length)


def pieces_of(n: int, length: int) -> list[tuple[int, int]]:
    """start, length of the pieces of a document of n tokens."""
    over = n % length
    starts = ([0] if over else []) + list(range(over, n, length))
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], n])]


def written(docs: DataFrame, tokenizer: str, end: int, length: int, path: str, keep_cache: bool = False) -> DataFrame:
    """doc_id, text -> pieces as Parquet: row (a number of its own for each document), doc_id, piece, start, length, ids_crc32, ids."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    small_batches(docs.sparkSession)
    dtype = id_type(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, dtype, KEPT if keep_cache else CACHE)
        last = np.array([end], dtype=dtype).tobytes()
        for b in batches:
            text = b.column(1)
            for s in slices(pa.compute.binary_length(text).to_pylist()):
                doc, row = (b.column(c)[s.start : s.stop].to_pylist() for c in (0, 2))
                out: list[list] = [[] for _ in range(7)]
                for doc_id, number, ids in zip(doc, row, enc.ids(text[s.start : s.stop].to_pylist())):
                    x = np.frombuffer(ids + last, dtype=dtype)
                    for n, (start, size) in enumerate(pieces_of(len(x), length)):
                        part = x[start : start + size]
                        for c, v in zip(out, (number, doc_id, n, start, size, zlib.crc32(part.astype("<u4").tobytes()), part.tobytes())):
                            c.append(v)
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["row", "doc_id", "piece", "start", "length", "ids_crc32", "ids"])
        if not keep_cache:
            enc.clear()
        release()

    d.mapInArrow(run, "row long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def placed(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """row, piece, length of pieces below a sequence's length -> row, piece, sequence_id, offset."""
    short = pieces.select("row", "piece", "length")
    total, n = short.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(1, -(-total // group), -(-n // ITEMS))
    d = short.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).repartitionById(groups, "group").sortWithinPartitions("group", "row", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            at = b.column(3).to_numpy()
            edges = np.flatnonzero(at[1:] != at[:-1]) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(b)]):
                if hi > lo:
                    if held and at[lo] != now:
                        yield _bins(held, now, length)
                        held = []
                    now = int(at[lo])
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield _bins(held, now, length)

    return d.mapInArrow(run, "row long, piece int, sequence_id long, offset long")


def _bins(held: list[pa.RecordBatch], group: int, length: int) -> pa.RecordBatch:
    t = pa.Table.from_batches(held)
    sizes = t.column("length").to_pylist()
    order, seq, offset = [], [], []
    for n, items in enumerate(packed(sizes, length)):
        at = 0
        for i in sorted(items):
            order.append(i)
            seq.append((group << 32) + n)
            offset.append(at)
            at += sizes[i]
    t = t.take(pa.array(order, pa.int64()))
    row, piece = (pa.array(t.column(c).to_numpy()) for c in ("row", "piece"))
    return pa.RecordBatch.from_arrays([row, piece, pa.array(seq, pa.int64()), pa.array(offset, pa.int64())], ["row", "piece", "sequence_id", "offset"])


def pack_best_fit(docs: DataFrame, tokenizer: str, end: int = END, length: int = LENGTH, group: int = GROUP, keep_cache: bool = False) -> DataFrame:
    """doc_id, text -> pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids."""
    pieces = written(docs, tokenizer, end, length, scratch(docs.sparkSession, "pieces"), keep_cache)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
    short = pieces.filter(F.col("length") < length)
    # A piece of a whole sequence is one, numbered below zero.
    whole = pieces.filter(F.col("length") == length).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return short.join(placed(short, length, group), ["row", "piece"]).select(columns).unionByName(whole.select(columns))
