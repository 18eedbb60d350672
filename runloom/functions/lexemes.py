"""The identifier-aware tokenizer, as one expression.

A word yields its whole lower-case form, the parts between its separators, and
the same for each of its camel-case parts; each form once per occurrence of the word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .memory import ROWS, release, small_batches

# Words that are not indexed.
STOP_WORDS = (
    "a an the and or but if then else of to in on at for from by with as is are "
    "was were be been being this that these those it its we you they there here "
    "do does did have has had will would should can could may might must"
).split()

WORD = r"[A-Za-z0-9_./:\-]+"
_SEPARATORS = r"[./:_\-]+"
_EDGE = "./:-_"
#: Between a lower-case letter or digit and a capital; before the last capital of a run.
_HUMPS = (r"(?<=[a-z0-9])(?=[A-Z])", r"(?<=[A-Z])(?=[A-Z][a-z])")


def _forms(x: Column) -> Column:
    low = F.btrim(F.lower(x), F.lit(_EDGE))
    return F.concat(F.array(low), F.split(low, _SEPARATORS))


def word_terms(word: Column) -> Column:
    parts = word
    for hump in _HUMPS:
        parts = F.regexp_replace(parts, hump, " ")
    found = F.concat(_forms(word), F.flatten(F.transform(F.split(parts, " "), _forms)))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS)))


def terms(text: Column) -> Column:
    """All terms of a text, in order, with repeats across words."""
    return F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), word_terms))


# -- the same in bulk: each distinct word is taken apart once by a worker -----------------

#: Words that a worker keeps with their terms, and the longest that it keeps.
KEPT, LONGEST = 50_000, 64
_FOUND = re.compile(WORD)
_SPLIT, _HUMP = re.compile(_SEPARATORS), re.compile("|".join(_HUMPS))
_STOPS = frozenset(STOP_WORDS)


def plain_word_terms(word: str) -> tuple[str, ...]:
    """``word_terms`` of one word."""
    out: dict[str, None] = {}
    for form in (word, *_HUMP.split(word)):
        low = form.lower().strip(_EDGE)
        for t in (low, *_SPLIT.split(low)):
            if len(t) > 1 and t not in _STOPS:
                out[t] = None
    return tuple(out)


def counted(rows: DataFrame, key: str, text: str, by_term: bool = True) -> DataFrame:
    """key, text -> key, term, tf, dl (``by_term``), or key, dl: the terms of a text, how often, and how many in all.

    One pass over Arrow batches and no shuffle: a text's terms are counted where it lies.
    """
    from pyspark.sql.types import StructType

    small_batches(rows.sparkSession)
    d = rows.select(key, F.col(text).cast("string").alias("_text"))
    schema = StructType([d.schema[key], *StructType.fromDDL("term string, tf long, dl long" if by_term else "dl long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        for b in batches:
            at, terms_, tf, dl = [], [], [], []
            for i, x in enumerate(b.column(1)):
                total: Counter[str] = Counter()
                for w, n in Counter(_FOUND.findall(x.as_py() or "")).items():
                    found = known.get(w)
                    if found is None:
                        found = plain_word_terms(w)
                        if len(w) <= LONGEST:
                            if len(known) >= KEPT:
                                known.clear()
                            known[w] = found
                    for t in found:
                        total[t] += n
                size = sum(total.values())
                if by_term:
                    at += [i] * len(total)
                    terms_ += total.keys()
                    tf += total.values()
                    dl += [size] * len(total)
                else:
                    at.append(i)
                    dl.append(size)
                if len(at) > ROWS:
                    yield _counted(b, at, terms_, tf, dl, by_term, schema)
                    at, terms_, tf, dl = [], [], [], []
            yield _counted(b, at, terms_, tf, dl, by_term, schema)
        known.clear()
        release()

    return d.mapInArrow(run, schema)


def _counted(b: pa.RecordBatch, at: list[int], terms_: list[str], tf: list[int], dl: list[int], by_term: bool, schema) -> pa.RecordBatch:
    key = b.column(0).take(pa.array(at, pa.int64()))
    columns = [key, pa.array(terms_, pa.string()), pa.array(tf, pa.int64()), pa.array(dl, pa.int64())] if by_term else [key, pa.array(dl, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, schema.fieldNames())


# -- the same by columns: only some terms are looked for, and only words with parts are taken apart one by one --

#: What a byte is to a word: none of it, a small letter or digit, a capital (the bit that makes it small), a separator.
_SMALL, _CAPITAL, _SEPARATOR = 0x01, 0x20, 0x40
_KINDS = bytes(_SMALL if 97 <= i <= 122 or 48 <= i <= 57 else _CAPITAL if 65 <= i <= 90 else _SEPARATOR if chr(i) in _EDGE else 0 for i in range(256))
#: A word up to WIDE bytes is two numbers of eight bytes, with nought after its end; masks of the first 0 to 8 bytes.
WIDE = 16
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], "<u8")
_EACH = np.uint64(0x0101010101010101)
_CAPITALS, _PARTED, _REST = _EACH * np.uint64(_CAPITAL), _EACH * np.uint64(_CAPITAL | _SEPARATOR), ~np.uint64(_CAPITAL)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _eights(data: bytes) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))


def _pairs(begin: np.ndarray, length: np.ndarray, *of: bytes) -> list[np.ndarray]:
    """The pairs of words in each of ``of``, one after the other."""
    low, high, next_ = _MASKS[np.minimum(length, 8)], _MASKS[np.clip(length - 8, 0, 8)], begin + 8
    return [y for x in map(_eights, of) for y in (x[begin] & low, x[next_] & high)]


class _Numbers:
    """Numbers of known words of small letters and digits, by their pairs."""

    def __init__(self, words: list[str]) -> None:
        self.known = [w for w in words if 1 < len(w) <= WIDE and w.isascii() and w.isalnum() and w == w.lower()]
        text = "".join(self.known).encode() + bytes(WIDE)
        length = np.array([len(w) for w in self.known], np.int64)
        self.low, self.high = _pairs(np.cumsum(length) - length, length, text)
        self.mix = _MIX
        while len(set((self.low + self.high * self.mix).tolist())) < len(self.known):  # no two may share a sum
            self.mix = self.mix * _MIX
        self.sums = pa.array(self.low + self.high * self.mix, pa.uint64())

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place in ``known``, -1 for others."""
        at = pc.fill_null(pc.index_in(pa.array(low + high * self.mix, pa.uint64()), value_set=self.sums), -1).to_numpy(zero_copy_only=False)
        hit = np.flatnonzero(at >= 0)
        other = hit[(self.low[at[hit]] != low[hit]) | (self.high[at[hit]] != high[hit])]
        if len(other):
            at = at.copy()
            at[other] = -1
        return at


def looker(wanted: list[str]) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A function of texts: row, term (its number in ``wanted``) and tf of the wanted terms, by row and term; and dl of each text, of all its terms."""
    number = {t: i for i, t in enumerate(wanted)}
    numbers, width = _Numbers([*STOP_WORDS, *(t for t in number if t not in _STOPS)]), max(1, len(wanted))
    stops = sum(w in _STOPS for w in numbers.known)
    place = np.array([number[w] for w in numbers.known[stops:]], np.int64)

    def look(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        # Each text ends in a byte of no word, and one stands before the first.
        joined = pc.binary_join_element_wise(pc.fill_null(texts, ""), "", "\n")
        bounds = np.concatenate([[0], np.cumsum(pc.binary_length(joined).to_numpy(zero_copy_only=False).astype(np.int64))]) + 1
        data = b"".join([b"\n", *([memoryview(joined.buffers()[2])[: bounds[-1] - 1]] if len(joined) else []), bytes(WIDE)])
        kinds = data.translate(_KINDS)
        kind = np.frombuffer(kinds, np.uint8)
        inside = kind != 0
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        begin, end = edges[::2].copy(), edges[1::2].copy()
        # Two separators at an end are cut off; words with more have parts, and are few.
        for _ in range(2):
            end -= kind[end - 1] == _SEPARATOR
            begin += kind[begin] == _SEPARATOR
        length = end - begin
        used = np.flatnonzero(length > 1)
        begin, end, length = begin[used], end[used], length[used]
        low, high, kind_low, kind_high = _pairs(begin, length, data, kinds)
        plain = (((kind_low & _REST) | kind_high) & _PARTED) == 0
        parted = np.flatnonzero(~plain)
        # Capitals alone are one term as well.
        n = length[parted]
        alone = (kind_low[parted] == _CAPITALS & _MASKS[np.minimum(n, 8)]) & (kind_high[parted] == _CAPITALS & _MASKS[np.clip(n - 8, 0, 8)])
        plain[parted[alone]] = True
        plain &= length <= WIDE
        at = numbers.of(low | (kind_low & _CAPITALS), high | (kind_high & _CAPITALS))
        dl = np.diff(np.searchsorted(begin[plain & ((at < 0) | (at >= stops))], bounds))
        hit = np.flatnonzero(plain & (at >= stops))
        rows = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(begin[hit], bounds)))
        terms_ = place[at[hit] - stops]
        others = np.flatnonzero(~plain)
        if len(others):
            row = np.searchsorted(bounds, begin[others], "right") - 1
            ends = np.stack([begin[others], end[others]], 1).astype(np.int32).ravel()
            words = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data)).take(pa.array(np.arange(0, len(ends), 2)))
            told = words.dictionary_encode()
            code, size, many, parts = told.indices.to_numpy(zero_copy_only=False), [], [], []
            for w in told.dictionary.to_pylist():
                found = plain_word_terms(w)
                mine = [number[t] for t in found if t in number]
                size.append(len(found))
                many.append(len(mine))
                parts += mine
            dl += np.bincount(row, np.array(size)[code], len(texts)).astype(np.int64)
            if parts:
                many = np.array(many)
                rows = np.concatenate([rows, np.repeat(row, many[code])])
                terms_ = np.concatenate([terms_, np.array(parts, np.int64)[spans((np.cumsum(many) - many)[code], many[code])]])
        key, tf = np.unique(rows * width + terms_, return_counts=True)
        return key // width, key % width, tf, dl

    return look


def spans(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin, begin + 1 and so on, ``length`` of them, one span after the other."""
    before = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(begin - before, length)
