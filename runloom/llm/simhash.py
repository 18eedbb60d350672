"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64 bits over three-word shingles. Two fingerprints link at three or
fewer differing bits; a group is a connected component.

1. Texts become fingerprints (Arrow batches, NumPy). Only distinct fingerprints go on,
   so exact copies never meet in pairs.
2. Bit correlations over all distinct fingerprints group the 64 bits into PARTS
   parts. For each part and threshold, pairs are counted from the part's value
   histogram (2^16 values at most); dynamic programming picks the thresholds,
   -1 (skip) and up, that sum up to LIMIT - PARTS + 1 at least cost. By the
   generalised pigeonhole principle, any linked pair meets in some part.
3. Each fingerprint is filed under its own value of a part, and under values
   within the part's threshold. A bucket compares its members and hands on a
   spanning forest of the verified links, not all pairs. Buckets above HOT rows are
   divided anew by the pigeonhole over the bits outside their key, until
   they are small or the bits run out; the rest is compared in blocks.
4. Components come from alternating large and small stars, checkpointed each round.

Cases: a null or empty text, or one without words, has fingerprint zero and links
like any other. With one or two words, the sequence is the one shingle. A null
doc_id never names a component unless all its ids are null. Repeated
rows get the same component. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import checkpoint, release, shuffle_partitions, small_batches

LIMIT = 3
PARTS = 4
WIDTH = 3
HOT = 4096
LEVELS = 3
#: Near copies of the pipeline: words of a shingle, least Jaccard similarity, bands of four min-hashes each.
COPY_WIDTH = 5
SIMILARITY = 0.8
BANDS = 16
#: For each byte value, its bits in the eight byte lanes of a word.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()
_ODD, _MASK = np.random.default_rng(29).integers(0, 1 << 63, (2, 4 * BANDS), dtype=np.uint64)
_ODD = _ODD * np.uint64(2) + np.uint64(1)


def hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The XXH64 (seed 42) of each shingle of a text."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = partial(xxhash.xxh64_intdigest, seed=42)
    if len(w) <= width:
        return np.fromiter([h(b" ".join(w))] if w else [], dtype=np.uint64)
    return np.fromiter(map(h, map(b" ".join, zip(*(w[i:] for i in range(width))))), dtype=np.uint64, count=len(w) - width + 1)


def fold(groups: list[np.ndarray]) -> np.ndarray:
    """One fingerprint for each group of hashes; zero for none."""
    out = np.zeros(len(groups), dtype=np.uint64)
    size = np.array([len(g) for g in groups], dtype=np.int64)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    h = np.concatenate([groups[i] for i in full]).view(np.uint8).reshape(-1, 8)
    n = size[full]
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    # Lanes are bytes: they are summed over 255 rows at most, then the sums are summed.
    cuts = -(-n // 255)
    at = np.repeat(first, cuts) + 255 * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    bits = np.empty((len(full), 64), dtype=np.int64)
    for j in range(8):
        lanes = np.add.reduceat(_LANES[h[:, j]], at).view(np.uint8).reshape(-1, 8)
        bits[:, 8 * j : 8 * j + 8] = np.add.reduceat(lanes.astype(np.int64), np.cumsum(cuts) - cuts, axis=0)
    set_ = (2 * bits > n[:, None]).astype(np.uint8)
    out[full] = np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text -> keys, fp (the bits as a long)."""
    from pyspark.sql.types import LongType, StructType

    small_batches(docs.sparkSession)
    d = docs.select(*keys, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, done, held, n = b.column(len(keys)), [], [], 0
            for i in range(len(b)):
                held.append(hashes(text[i].as_py()))
                n += len(held[-1])
                if n > 200_000:
                    done.append(fold(held))
                    held, n = [], 0
            done.append(fold(held))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(np.concatenate(done).view(np.int64))], [*keys, "fp"])

    return d.mapInArrow(run, StructType([*d.select(*keys).schema.fields]).add("fp", LongType()))


# -- parts and thresholds --------------------------------------------------------------


def bit_counts(fps: DataFrame) -> tuple[np.ndarray, int]:
    """How often two bits are set together, over all fingerprints: 64 x 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for b in batches:
            x = _bits(b.column(0).to_numpy(zero_copy_only=False))
            total += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array([*total.ravel(), float(n)])], ["i", "n"])

    rows = fps.select("fp").mapInArrow(run, "i long, n double").groupBy("i").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(4097)
    for i, n in rows:
        flat[i] = n
    return flat[:4096].reshape(64, 64), int(flat[4096])


def _bits(fp: np.ndarray) -> np.ndarray:
    raw = np.ascontiguousarray(fp.astype(np.int64)).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little").astype(np.float64)


def group_bits(together: np.ndarray, n: int, parts: int = PARTS) -> list[list[int]]:
    """Greedy groups: start with the strongest pair left, add the bit most correlated with the group."""
    p = together / max(n, 1)
    one = np.diag(p)
    spread = np.sqrt(np.clip(one * (1 - one), 1e-12, None))
    corr = np.abs((p - np.outer(one, one)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(64)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        rest = sorted(left)
        sub = corr[np.ix_(rest, rest)]
        group = [rest[i] for i in np.unravel_index(int(sub.argmax()), sub.shape)] if size > 1 else rest[:1]
        group = list(dict.fromkeys(group))
        while len(group) < size:
            more = sorted(left - set(group))
            group.append(more[int(corr[np.ix_(more, group)].sum(axis=1).argmax())])
        left -= set(group)
        groups.append(sorted(group))
    return groups


def part_values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    x = fp.astype(np.int64).view(np.uint64)
    out = np.zeros(len(x), dtype=np.int64)
    for j, b in enumerate(bits):
        out |= ((x >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << j
    return out


def _balls(bits: int, radius: int) -> list[int]:
    """All differences of ``radius`` bits at most, none first."""
    from itertools import combinations

    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def candidate_counts(histogram: np.ndarray, bits: int, most: int) -> list[float]:
    """Work for thresholds -1, 0, ..., most: rows filed plus pairs that meet."""
    n, v = float(histogram.sum()), np.arange(len(histogram))
    cost, pairs = [0.0], 0.0
    for r in range(most + 1):
        for d in _balls(bits, r)[len(_balls(bits, r - 1)) if r else 0 :]:
            pairs += float((histogram * histogram[v ^ d]).sum()) / 2
        cost.append(pairs + n * len(_balls(bits, r)))
    return cost


def allocate(costs: list[list[float]], limit: int = LIMIT) -> list[int]:
    """Thresholds of least total cost whose sum is limit - parts + 1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (v, chosen) in best.items():
            for k, x in enumerate(c):
                t = s + k - 1
                if t not in step or v + x < step[t][0]:
                    step[t] = (v + x, [*chosen, k - 1])
        best = step
    return best[limit - len(costs) + 1][1]


def plan_parts(fps: DataFrame) -> list[tuple[list[int], int]]:
    """The parts' bits and thresholds. All fingerprints are counted; 4 x 2^16 counts are gathered."""
    together, n = bit_counts(fps)
    groups = group_bits(together, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(1 << len(g), dtype=np.int64) for g in groups]
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for c, g in zip(count, groups):
                c += np.bincount(part_values(fp, g), minlength=len(c))
        for k, c in enumerate(count):
            v = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k)), pa.array(v), pa.array(c[v])], ["part", "value", "n"])

    counted = fps.select("fp").mapInArrow(run, "part long, value long, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).toArrow()
    part, value, many = (counted.column(i).to_numpy() for i in range(3))
    costs = []
    for k, g in enumerate(groups):
        h = np.zeros(1 << len(g))
        h[value[part == k]] = many[part == k]
        costs.append(candidate_counts(h, len(g), 2))
    return list(zip(groups, allocate(costs)))


# -- probing and verifying -------------------------------------------------------------


def file_keys(rows: DataFrame, parts: list[tuple[list[int], int]], level: int) -> DataFrame:
    """(key, own, fp) of each fingerprint. At deeper levels, rows have the key that was too large.

    A deeper key is the old key's text and the new one's, so no two buckets mix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(b.schema.names.index("fp")).to_numpy(zero_copy_only=False)
            old = b.column(b.schema.names.index("key")).to_pylist() if level else None
            own = b.column(b.schema.names.index("own")).to_numpy(zero_copy_only=False) if level else np.ones(len(fp), dtype=bool)
            for k, (bits, radius) in enumerate(parts):
                if radius < 0:
                    continue
                v = part_values(fp, bits)
                for d in _balls(len(bits), radius):
                    key = [f"{k}:{x:x}" for x in (v ^ d).tolist()]
                    key = [f"{o}/{x}" for o, x in zip(old, key)] if level else key
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(own & (d == 0)), pa.array(fp)], ["key", "own", "fp"])

    return rows.mapInArrow(run, "key string, own boolean, fp long")


class Forest:
    """Union-find over fingerprints; the smaller number is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in self.up if (r := self.find(x)) != x]


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= LIMIT


def compare_bucket(fp: np.ndarray, own: np.ndarray, forest: Forest, block: int = 1024) -> None:
    """Link the members of one bucket; a row that is not its own is only compared with own ones."""
    x = fp.view(np.uint64)
    mine = x[own]
    for i in range(0, len(x), block):
        part = x[i : i + block]
        for j in range(0, len(mine), block):
            r, c = np.nonzero(_near(part[:, None], mine[None, j : j + block]))
            a, b = part[r], mine[j + c]
            keep = a != b
            for p, q in zip(a[keep].view(np.int64).tolist(), b[keep].view(np.int64).tolist()):
                forest.link(p, q)


def verified(filed: DataFrame) -> DataFrame:
    """(key, own, fp) -> spanning forest (a, b) of the links of each partition's buckets.

    Rows are dealt by the key's hash: dealing them by the key itself is left out after a join by it, and that join,
    broadcast or split at run time, may then leave a bucket's rows in several tasks, which never meet.
    """
    rows = filed.repartition(shuffle_partitions(filed.sparkSession), F.xxhash64("key")).sortWithinPartitions("key").select("key", "own", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), None
        for b in batches:
            t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
            key = t.column("key").combine_chunks().dictionary_encode()
            code = key.indices.to_numpy() if isinstance(key, pa.DictionaryArray) else key.chunk(0).indices.to_numpy()
            fp, own = t.column("fp").to_numpy(), t.column("own").to_numpy()
            last = int(np.searchsorted(code, code[-1]))
            bunch(code[:last], fp[:last], own[:last], forest)
            held = t.slice(last).to_batches()[0]
        if held is not None:
            bunch(np.zeros(len(held)), held.column(2).to_numpy(), held.column(1).to_numpy(zero_copy_only=False), forest)
        e = forest.edges()
        for i in range(0, len(e), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in e[i : i + 50_000]], pa.int64()), pa.array([q for _, q in e[i : i + 50_000]], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def bunch(code: np.ndarray, fp: np.ndarray, own: np.ndarray, forest: Forest) -> None:
    """Compare all buckets of a run of rows that is sorted by bucket."""
    if not len(code):
        return
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    size = np.diff(np.concatenate([first, [len(code)]]))
    for i in np.flatnonzero(size > 32):
        s = slice(first[i], first[i] + size[i])
        compare_bucket(fp[s], own[s], forest)
    small = np.repeat(size <= 32, size)
    code, x, own = code[small], fp[small].view(np.uint64), own[small]
    for k in range(1, 32):
        if len(x) <= k:
            break
        same = code[k:] == code[:-k]
        if not same.any():
            break
        hit = np.flatnonzero(same & (own[k:] | own[:-k]) & (x[k:] != x[:-k]) & _near(x[k:], x[:-k]))
        for p, q in zip(x[hit].view(np.int64).tolist(), x[hit + k].view(np.int64).tolist()):
            forest.link(p, q)


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Distinct fingerprints -> links (a, b), a forest of each bucket's links."""
    parts = plan_parts(fps)
    filed = file_keys(fps.select("fp"), parts, 0)
    found = []
    for level in range(1, LEVELS + 1):
        last = level == LEVELS
        if not last:
            filed = checkpoint(filed)
            large = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("key")
            large = checkpoint(large)
            if large.isEmpty():
                last = True
        if last:
            found.append(verified(filed))
            break
        found.append(verified(filed.join(large, "key", "left_anti")))
        filed = _divide(filed.join(large, "key"), parts)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.distinct()


def _divide(rows: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """Keys of a bucket that is too large, divided anew over the bits outside its key.

    Within a part of threshold zero the members agree in its bits, so the rest holds all their differences and
    the pigeonhole over PARTS new parts misses none. A part with a wider threshold
    has rows of other values: the same holds for the bits that lie outside it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, own, fp = b.column(0).to_pylist(), b.column(1), b.column(2).to_numpy(zero_copy_only=False)
            top = np.array([int(k.split(":")[0]) for k in keys])
            for p in np.unique(top):
                at = np.flatnonzero(top == p)
                deep = keys[at[0]].count("/")
                rest = [x for x in range(64) if x not in parts[p][0]]
                for d in range(1, deep + 1):
                    q = [int(keys[i].split("/")[d].split(":")[0]) for i in at]
                for k in range(PARTS):
                    chosen = rest[k::PARTS]
                    if deep:  # below the second level: the part that was chosen there is known, the rest is divided
                        for c in sorted(set(q)):
                            sub = at[np.array(q) == c]
                            left = [x for x in rest if x not in rest[c::PARTS]][k::PARTS]
                            yield _rekeyed(keys, own, fp, sub, left, k)
                    else:
                        yield _rekeyed(keys, own, fp, at, chosen, k)

    return rows.select("key", "own", "fp").mapInArrow(run, "key string, own boolean, fp long")


def _rekeyed(keys: list[str], own: pa.Array, fp: np.ndarray, at: np.ndarray, bits: list[int], k: int) -> pa.RecordBatch:
    v = part_values(fp[at], bits).tolist()
    return pa.RecordBatch.from_arrays([pa.array([f"{keys[i]}/{k}:{x:x}" for i, x in zip(at.tolist(), v)], pa.string()), own.take(pa.array(at)), pa.array(fp[at])], ["key", "own", "fp"])


# -- components ------------------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Edges (a, b) -> (node, root): the least node of each component, by alternating stars."""
    e = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    sign = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    old = sign(e)
    for _ in range(rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: neighbours above a node point to its least neighbour.
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: a node and its lower neighbours point to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "m").union(low.select(F.col("a").alias("x"), "m"))
        new = checkpoint(small.filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct())
        # A round that changes nothing ends it: then each node has one root, and roots have none.
        before, old, e = old, sign(new), new
        if old == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, keys: list[str] | None = None, hot: int = HOT) -> DataFrame:
    """keys (the first is the id), text -> keys, fp, component_id."""
    keys = keys or ["doc_id"]
    d = checkpoint(fingerprints(docs, keys))
    # Two steps, so that copies that hold a third of all rows are counted where they lie.
    fps = checkpoint(d.groupBy("fp").agg(F.min(keys[0]).alias("rep")))
    roots = components(links(fps, hot))
    classes = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = classes.join(least, "root").select("fp", "component_id")
    return d.join(classes, "fp").select(*keys, "fp", "component_id")


def fingerprint_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# -- the pipeline's near copies: five-word shingles, exact Jaccard ----------------------

#: Members of a bucket that are held at once, by rows and by bytes of their texts.
HOME, HOME_BYTES = 4096, 16 << 20


def sketch(text: str | None) -> tuple[bytes, int, np.ndarray, list[int]]:
    """A digest of the text's set of shingles and its size, the hashes for the fingerprint, and one key for each band of min-hashes."""
    import xxhash

    every = hashes(text, COPY_WIDTH)
    h = np.unique(every)
    digest = xxhash.xxh3_128_digest(h.tobytes())
    if not len(h):
        return digest, 0, every, []
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(h), 2048):
        least = np.minimum(least, ((h[None, i : i + 2048] ^ _MASK[:, None]) * _ODD[:, None]).min(axis=1))
    rows = np.ascontiguousarray(least.reshape(BANDS, -1))
    return digest, len(h), every, [xxhash.xxh64_intdigest(r.tobytes(), seed=k) - (1 << 63) for k, r in enumerate(rows)]


def sketches(docs: DataFrame) -> DataFrame:
    """_key, text -> _key, digest, n, fp, bands."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, sizes, fps, bands, held, n = [], [], [], [], [], 0
            for x in b.column(1):
                digest, size, every, keys = sketch(x.as_py())
                digests.append(digest)
                sizes.append(size)
                bands.append(keys)
                held.append(every)
                n += len(every)
                if n > 200_000:
                    fps.append(fold(held))
                    held, n = [], 0
            fps.append(fold(held))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(np.concatenate(fps).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))], ["_key", "digest", "n", "fp", "bands"])
        release()

    return docs.select("_key", "text").mapInArrow(run, "_key binary, digest binary, n long, fp long, bands array<long>")


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text. Texts are what is shuffled: they compress, hashes don't."""
    return np.unique(hashes(text, COPY_WIDTH))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted sets of hashes."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def similar(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b) -> those whose sets of shingles have the Jaccard similarity or more."""
    p = pairs.join(texts.toDF("a", "x").hint("merge"), "a").join(texts.toDF("b", "y").hint("merge"), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [jaccard(shingles(x.as_py()), shingles(y.as_py())) >= similarity for x, y in zip(b.column(2), b.column(3))]
            kept = b.filter(pa.array(near, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    return p.mapInArrow(run, "a long, b long")


class Home:
    """Sets of shingles, indexed for counting what each shares with others."""

    RARE, COLUMNS = 16, 1024

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(x) for x in sets], dtype=np.int64)
        flat, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(flat, kind="stable")
        self.who = who[order]
        self.value, self.first, self.times = np.unique(flat[order], return_index=True, return_counts=True)

    def shared(self, sets: list[np.ndarray]) -> np.ndarray:
        """How many shingles each of ``sets`` shares with each set at home: frequent ones by products, the others by their lists."""
        n = len(self.size)
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(self.value, flat), len(self.value) - 1)
        hit = self.value[at] == flat
        at, row = at[hit], row[hit]
        few = self.times[at] <= self.RARE
        times = self.times[at[few]]
        place = np.repeat(self.first[at[few]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        out = np.bincount(np.repeat(row[few], times) * n + self.who[place], minlength=len(sets) * n).reshape(len(sets), n)
        at, row = at[~few], row[~few]
        used, column = np.unique(at, return_inverse=True)
        for lo in range(0, len(used), self.COLUMNS):
            part = used[lo : lo + self.COLUMNS]
            times = self.times[part]
            place = np.repeat(self.first[part], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            home, guest = np.zeros((n, len(part)), dtype=np.float32), np.zeros((len(sets), len(part)), dtype=np.float32)
            home[self.who[place], np.repeat(np.arange(len(part)), times)] = 1
            here = (column >= lo) & (column < lo + len(part))
            guest[row[here], column[here] - lo] = 1
            out = out + (guest @ home.T).astype(np.int64)
        return out


def across(filed: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(band, node, root) -> a forest of the links between members of a bucket that have different roots.

    Each member is at home in one block of its bucket; those that don't have the bucket's most frequent root are
    guests of all other blocks. A task holds one block, compares its members and lets its guests pass by: no pairs are
    made but in its memory.
    """
    sized = filed.join(texts.select("node", F.octet_length("text").alias("size")), "node")
    by_root = sized.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    plan = by_root.groupBy("band").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.greatest(F.ceil(F.sum("n") / HOME), F.ceil(F.sum("size") / HOME_BYTES)).cast("int").alias("blocks")
    )
    rows = filed.join(plan, "band").withColumn("home", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("main", F.col("root") == F.col("main"))
    home = rows.select("band", F.col("home").alias("block"), F.lit(0).alias("side"), "node", "root", "main")
    guests = rows.filter("not main and blocks > 1").select("band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "node", "root", "main", "home")
    met = home.union(guests.filter("block <> home").drop("home")).join(texts, "node").select("band", "block", "side", "node", "root", "main", "text")
    met = met.repartition(shuffle_partitions(filed.sparkSession), "band", "block").sortWithinPartitions("band", "block", "side", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, now, held, block = Forest(), None, [], None

        def compare(sets: list[np.ndarray], nodes: np.ndarray, roots: np.ndarray) -> None:
            index, at, of = block
            for i in range(0, len(sets), 256):
                both = index.shared(sets[i : i + 256])
                size = np.array([len(x) for x in sets[i : i + 256]])[:, None] + index.size[None, :] - both
                r, c = np.nonzero((both / np.maximum(size, 1) >= similarity) & (roots[i : i + 256, None] != of[None, :]))
                for p, q in zip(nodes[i + r].tolist(), at[c].tolist()):
                    forest.link(p, q)

        def settle() -> None:
            """All members of a block are there: compare those of lesser roots with all."""
            nonlocal block, held
            if not held:
                return
            sets = [x for h in held for x in h[0]]
            nodes, roots, main = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
            block, held = (Home(sets), nodes, roots), []
            few = np.flatnonzero(~main)
            compare([sets[i] for i in few.tolist()], nodes[few], roots[few])

        for b in batches:
            key = np.stack([b.column(i).to_numpy() for i in range(3)])
            edges = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(b)]):
                if hi <= lo:
                    continue
                if tuple(key[:2, lo]) != now:
                    settle()
                    now, block = tuple(key[:2, lo]), None
                part = b.slice(lo, hi - lo)
                own = [shingles(x.as_py()) for x in part.column(6)], part.column(3).to_numpy(), part.column(4).to_numpy(), part.column(5).to_numpy(zero_copy_only=False)
                if key[2, lo] == 0:
                    held.append(own)
                    continue
                settle()
                if block:
                    compare(own[0], own[1], own[2])
        settle()
        e = forest.edges()
        for i in range(0, len(e), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in e[i : i + 50_000]], pa.int64()), pa.array([q for _, q in e[i : i + 50_000]], pa.int64())], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def close_pairs(sets: DataFrame) -> DataFrame:
    """node, fp -> candidate pairs (a, b) by the fingerprints: equal ones, and those that the pigeonhole links."""
    fps = checkpoint(sets.groupBy("fp").agg(F.min("node").alias("node")))
    equal = sets.join(fps.toDF("fp", "b"), "fp").select(F.col("node").alias("a"), "b")
    linked = links(fps).toDF("x", "y").join(fps.toDF("x", "a"), "x").join(fps.toDF("y", "b"), "y").select("a", "b")
    return equal.union(linked).filter("a <> b")


def copy_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """_key (binary, equal for equal texts only), text -> _key (once each), root: components of texts with similar sets of five-word shingles.

    Texts of one set are one: a node, whose number is given once and written. Candidates are those that the pigeonhole over fingerprints links, and, as three of 64 bits
    are a far closer likeness than 0.8, texts that agree in a band of their min-hashes (at 0.8, a pair is missed with a
    probability of 0.0002). In a bucket, each member is first compared with its least one, in two orders; then, in buckets that still
    hold several components, all across these. A link is only what has the similarity, counted over all shingles.
    """
    # Two steps, so that copies that hold a third of all rows are counted where they lie.
    d = checkpoint(sketches(docs).groupBy("_key").agg(*[F.first(c).alias(c) for c in ("digest", "n", "fp", "bands")]))
    sets = checkpoint(d.groupBy("digest").agg(F.min("_key").alias("_key"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()))
    close = checkpoint(close_pairs(sets.select("node", "fp")))
    filed = sets.select("node", F.explode("bands").alias("band"))
    filed = checkpoint(filed.join(filed.groupBy("band").count().filter("count > 1").select("band"), "band").select("band", "node"))
    needed = filed.select("node").union(close.select("a")).union(close.select("b")).distinct()
    texts = docs.select("_key", "text").join(sets.select("_key", "node").join(needed, "node"), "_key")
    texts = checkpoint(texts.groupBy("node").agg(F.first("text").alias("text")))
    counts = sets.select("node", "n")
    links_, roots, tried = None, None, None
    for turn in range(2):
        if roots is not None:
            filed = _open(filed, roots)
        first = filed.groupBy("band").agg(F.min_by("node", F.struct(F.xxhash64("node", F.lit(turn)), "node")).alias("b"))
        pairs = filed.join(first, "band").select(F.col("node").alias("a"), "b").filter("a <> b")
        pairs = pairs if turn else pairs.union(close)
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        # Sets of too different sizes can't be that similar, whatever they share.
        pairs = pairs.join(counts.toDF("a", "n"), "a").join(counts.toDF("b", "m"), "b").filter(F.least("n", "m") >= similarity * F.greatest("n", "m")).select("a", "b")
        pairs = checkpoint(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.union(pairs)
        found = checkpoint(similar(pairs, texts, similarity))
        links_ = found if links_ is None else links_.union(found)
        roots = checkpoint(components(links_))
    filed = _open(filed, roots)
    if not filed.isEmpty():
        roots = checkpoint(components(links_.union(across(filed, texts, similarity))))
    sets = sets.select("digest", "node").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    return d.select("_key", "digest").join(sets, "digest").select("_key", "root")


def _open(filed: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, node) -> (band, node, root) of buckets that hold several components."""
    filed = filed.select("band", "node").join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    several = filed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("band")
    return checkpoint(filed.join(several, "band"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of near copies stays: the least doc_id (nulls last), then the least text digest.

    Texts are told apart by digests of 128 bits. Of rows that repeat an id and a text, the one with the least hash of its columns stays. Texts of fewer than five words are one
    shingle; null and empty texts are copies of each other. Columns keep their names, types and values.
    """
    text = F.col("text").cast("string")
    id_ = F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("n"))
    d = docs.select("doc_id", id_.alias("_i"), F.coalesce(F.unhex(F.md5(text)), F.unhex(F.lit(""))).alias("_h"), text.alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    least = d.groupBy("_h").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_i")).alias("k"))
    groups = copy_groups(d.select(F.col("_h").alias("_key"), "text"), similarity).withColumnRenamed("_key", "_h")
    one = groups.join(least, "_h").groupBy("root").agg(F.min(F.struct("k", "_h")).alias("x")).select(F.col("x.k._i").alias("_i"), F.col("x._h").alias("_h"))
    kept = d.select("_i", "_h", "_row").join(one, ["_i", "_h"], "left_semi")
    first = Window.partitionBy("_i", "_h").orderBy(F.xxhash64("_row"))
    return kept.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("_row.*")
