"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the sum over n = 1..3 of the share of character n-grams
(letters in lower case, other runs as one space) present in both,
|A and B| / sqrt(|A| |B|). Nyström: a few landmarks per language stand for the sample; ridge
regression, one language against the rest, is solved in their feature space. As
presence kernels are linear in the presence of n-grams, landmarks and coefficients fold into one
matrix for each n, and a batch of texts is scored by matrix products.

Learning takes PER_LANGUAGE labelled rows of each language at most (the least hashes of
doc_id), LANDMARKS of them as landmarks. The caller says which rows may be learned from.
n-grams are hashed into 2^18 bins for each n.

Cases: a text that is null or has no letter gets ``und`` and score 0, and so does any
text if nothing could be learned. Rows without a language teach nothing. Texts are read whole.
Repeated rows get the same answer. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

ORDERS = (1, 2, 3)
BITS = 18
PER_LANGUAGE = 400
LANDMARKS = 60
RIDGE = 1e-2
SHARPNESS = 4.0
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> its lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
            out[c] = ord(low) if len(low := s.lower()) == 1 else c
    return out


def letters(text: str) -> np.ndarray:
    """Letters in lower case, with one 32 for each run of anything else, and at both ends."""
    c = _letters()[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]
    c = np.concatenate([[0], c, [0]])
    c = c[(c != 0) | np.concatenate([[True], c[:-1] != 0])]
    return np.where(c == 0, 32, c).astype(np.uint64)


def bins(c: np.ndarray, n: int) -> np.ndarray:
    """The distinct hashed n-grams of a letter sequence."""
    if len(c) < n:
        return np.zeros(0, dtype=np.int64)
    code = np.zeros(len(c) - n + 1, dtype=np.uint64)
    for i in range(n):
        code = (code << np.uint64(21)) | c[i : len(c) - n + 1 + i]
    code = (code ^ (code >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    seen = np.zeros(1 << BITS, dtype=bool)
    seen[(code >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    languages: list[str]
    #: For each n: the bins that any landmark has, and their weights by language.
    vocabulary: list[np.ndarray]
    weights: list[np.ndarray]


def kernel(a: list[list[np.ndarray]], b: list[list[np.ndarray]]) -> np.ndarray:
    """Kernel matrix of two lists of texts, each given as its bins by n."""
    out = np.zeros((len(a), len(b)))
    for k in range(len(ORDERS)):
        used = np.unique(np.concatenate([x[k] for x in b])) if b else np.zeros(0, dtype=np.int64)
        other = _presence([x[k] for x in b], used)
        size_b = np.sqrt([max(len(x[k]), 1) for x in b])
        for i in range(0, len(a), 128):
            part = [x[k] for x in a[i : i + 128]]
            size = np.sqrt([max(len(x), 1) for x in part])
            out[i : i + 128] += (_presence(part, used) @ other.T) / np.outer(size, size_b)
    return out


def _presence(texts: list[np.ndarray], used: np.ndarray) -> np.ndarray:
    place = np.full(1 << BITS, -1, dtype=np.int64)
    place[used] = np.arange(len(used))
    out = np.zeros((len(texts), len(used)), dtype=np.float32)
    for i, x in enumerate(texts):
        at = place[x]
        out[i, at[at >= 0]] = 1
    return out


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Learn from (text, language); the first rows of each language are the landmarks."""
    rows = [(c, lang) for t, lang in rows if len(c := letters(t)) > 1]
    languages = sorted({lang for _, lang in rows})
    if not rows:
        return Model([], [], [])
    grams = [[bins(c, n) for n in ORDERS] for c, _ in rows]
    marks = [i for lang in languages for i in [j for j, r in enumerate(rows) if r[1] == lang][:landmarks]]
    base = [grams[i] for i in marks]
    vals, vecs = np.linalg.eigh(kernel(base, base))
    good = vals > 1e-8 * vals.max()
    root = vecs[:, good] / np.sqrt(vals[good])
    phi = kernel(grams, base) @ root
    y = np.array([[1.0 if lang == x else -1.0 for x in languages] for _, lang in rows])
    # Each language weighs the same, however many rows it has.
    share = np.array([1.0 / sum(r[1] == lang for r in rows) for _, lang in rows])[:, None]
    alpha = root @ np.linalg.solve(phi.T @ (phi * share) + ridge / len(rows) * np.eye(phi.shape[1]), phi.T @ (y * share))
    vocabulary, weights = [], []
    for k in range(len(ORDERS)):
        used = np.unique(np.concatenate([x[k] for x in base]))
        size = np.sqrt([max(len(x[k]), 1) for x in base])
        vocabulary.append(used)
        weights.append((_presence([x[k] for x in base], used).T @ (alpha / size[:, None])).astype(np.float32))
    return Model(languages, vocabulary, weights)


def predict(model: Model, texts: list[str | None], batch: int = 64) -> list[tuple[str, float]]:
    out: list[tuple[str, float]] = []
    places = []
    for v in model.vocabulary:
        place = np.full(1 << BITS, len(v), dtype=np.int64)
        place[v] = np.arange(len(v))
        places.append(place)
    for i in range(0, len(texts), batch):
        part = [letters(t or "") for t in texts[i : i + batch]]
        f = np.zeros((len(part), len(model.languages)))
        for k, n in enumerate(ORDERS if model.languages else ()):
            p = np.zeros((len(part), len(model.vocabulary[k]) + 1), dtype=np.float32)
            size = np.ones(len(part))
            for j, c in enumerate(part):
                x = bins(c, n)
                p[j, places[k][x]] = 1
                size[j] = max(len(x), 1)
            f += (p[:, :-1] @ model.weights[k]) / np.sqrt(size)[:, None]
        for c, s in zip(part, f):
            if len(c) <= 1 or not model.languages:
                out.append((UNKNOWN, 0.0))
                continue
            e = np.exp(SHARPNESS * (s - s.max()))
            best = int(np.argmax(s))
            out.append((model.languages[best], float(e[best] / e.sum())))
    return out


def learn(docs: DataFrame, may_learn: Column, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on a bounded sample of labelled rows, the same at each run."""
    d = docs.filter(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    h = F.xxhash64("doc_id")
    # Of a language with many rows, only about twice the rows wanted go on to be ranked: the least hashes.
    share = F.pmod(h, F.lit(1 << 31)) / float(1 << 31)
    many = F.broadcast(d.groupBy("lang").agg(F.count(F.lit(1)).alias("many")))  # one row a language
    some = d.select("doc_id", "lang", share.alias("h")).join(many, "lang").filter(F.col("h") <= 2.0 * per_language / F.col("many"))
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = some.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_language)
    # per_language ids for each language: bounded, as languages are few. Rows that repeat an id count once.
    ids = F.broadcast(ids.groupBy("doc_id", "lang").agg(F.min("n").alias("n")))
    picked = d.select("doc_id", "text", "lang").join(ids, ["doc_id", "lang"]).groupBy("doc_id", "lang", "n").agg(F.max("text").alias("text"))
    rows = picked.select("text", "lang", "n", "doc_id").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["lang"], r["n"], r["doc_id"] is None, r["doc_id"], r["text"]))
    return fit([(r["text"], r["lang"]) for r in rows])


def identify(docs: DataFrame, may_learn: Column, keep: list[str]) -> DataFrame:
    """``keep`` columns, lang_pred, score."""
    from pyspark.sql.types import StructType

    model = docs.sparkSession.sparkContext.broadcast(learn(docs, may_learn))
    d = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = StructType([*docs.select(*keep).schema.fields, *StructType.fromDDL("lang_pred string, score double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 512):
                part = b.slice(i, 512)
                found = predict(model.value, part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], schema.fieldNames())

    return d.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """One row in five, by the checksum of the id; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))
