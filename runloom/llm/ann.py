"""Nearest neighbours by inner product: a forest of random-projection trees.

1. All vectors are counted and the largest component and norm found; a further component
   sqrt(norm_max^2 - norm^2) turns inner products into angles, so that trees, which split
   by direction, serve unnormalised vectors too. Trees see vectors divided by the largest component, so that no norm overflows.
2. TREES trees are fitted on a sample of SAMPLE vectors at most (the least hashes of
   vec_id): each node splits at the median projection on the difference of two sample points.
   The greatest depth follows the row count, LEAF rows a leaf, as far as the sample has
   LEAST_SAMPLE points for each leaf: 2^14 leaves a tree, after which leaves grow. A tree cut at a lesser depth is a
   tree as well; which depth is used, is measured too (see 4).
3. Every row is filed in its leaf of each tree.
4. Each query searches all trees through one priority queue: a node's priority is the least
   margin on its path by which the query lies on the other side. Since the near child
   keeps its parent's priority, taking the best nodes of all trees level by
   level gives exactly the leaves that a heap would pop first. How many leaves is measured: a pass over the
   table finds the exact neighbours of TRIALS queries, and the search takes as many
   leaves as their recall needs to reach HOLD (see ``probes_for``), TREES at least. Of several depths, the one of least
   work is used: vectors in clusters call for many small leaves, vectors without structure for few large
   ones. ``probes`` of all leaves makes the search exact.
5. Leaf by leaf, queries meet rows in blocks and are scored exactly, in double precision; the
   best of all leaves are merged. A leaf with more than BLOCK rows is
   spread over several tasks, each of which gets the leaf's queries.
6. Queries whose leaves held fewer than k rows (while there are more) are answered by a pass over all rows.

Cases: vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do rows without an id. Vectors of each length are a table of their own. Rows are told apart
by a number, not by their ids: repeated ids and repeated rows each have a list of their own, and each other
as candidates; only a query's own row is left out. Ties go to the smaller id. Products beyond the doubles are infinite.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpoint, shuffle_partitions

TREES = 8
SAMPLE = 65_536
LEAF = 128
LEAST_SAMPLE = 4
#: Visiting a leaf costs as much as scoring so many rows.
VISIT = 400
#: Queries (by another hash than the sample's) whose exact neighbours settle the probes, and the recall they are to reach.
TRIALS = 128
HOLD = 0.95
BLOCK = 8192
K = 20
#: Places beyond k that a block's fast path looks at, for rows whose scores are ties but for rounding.
MARGIN = 12


class Forest:
    """Complete trees: at level d, node i has the children 2i and 2i + 1."""

    def __init__(self, sample: np.ndarray, n_trees: int, depth: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.depth, self.n_trees = depth, n_trees
        dims = sample.shape[1]
        self.normals = [np.zeros((n_trees, 1 << d, dims)) for d in range(depth)]
        self.offsets = [np.zeros((n_trees, 1 << d)) for d in range(depth)]
        for t in range(n_trees):
            groups = [np.arange(len(sample))]
            for d in range(depth):
                below = []
                for i, g in enumerate(groups):
                    normal = np.zeros(dims)
                    for _ in range(5):
                        if len(g) >= 2:
                            a, b = sample[rng.choice(g, 2, replace=False)]
                            normal = a - b
                        if normal.any():
                            break
                    else:
                        normal = rng.standard_normal(dims)
                    normal = normal / np.linalg.norm(normal)
                    p = sample[g] @ normal
                    offset = float(np.median(p)) if len(g) else 0.0
                    self.normals[d][t, i], self.offsets[d][t, i] = normal, offset
                    below += [g[p <= offset], g[p > offset]]
                groups = below

    def cut(self, depth: int) -> Forest:
        """The same trees without the levels below ``depth``."""
        out = object.__new__(Forest)
        out.depth, out.n_trees, out.normals, out.offsets = depth, self.n_trees, self.normals[:depth], self.offsets[:depth]
        return out

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree: (rows, trees)."""
        out = np.zeros((len(x), self.n_trees), dtype=np.int64)
        for t in range(self.n_trees):
            at = out[:, t]
            for d in range(self.depth):
                side = np.einsum("ij,ij->i", x, self.normals[d][t][at]) > self.offsets[d][t][at]
                at = 2 * at + side
            out[:, t] = at
        return out

    def search(self, q: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """Trees and leaves, (queries, probes at most) each, best priority first."""
        n = len(q)
        tree = np.tile(np.arange(self.n_trees), (n, 1))
        node = np.zeros_like(tree)
        rank = np.full(tree.shape, np.inf)
        for d in range(self.depth):
            margin = np.einsum("ij,ikj->ik", q, self.normals[d][tree, node]) - self.offsets[d][tree, node]
            near = (margin > 0).astype(np.int64)
            tree = np.concatenate([tree, tree], axis=1)
            node = np.concatenate([2 * node + near, 2 * node + 1 - near], axis=1)
            rank = np.concatenate([rank, np.minimum(rank, -np.abs(margin))], axis=1)
            if rank.shape[1] > probes:
                best = np.argsort(-rank, axis=1, kind="stable")[:, :probes]
                tree, node, rank = (np.take_along_axis(x, best, axis=1) for x in (tree, node, rank))
        return tree, node


def augment(x: np.ndarray, norm_max: float, query: bool = False) -> np.ndarray:
    more = np.zeros(len(x)) if query else np.sqrt(np.clip(norm_max**2 - (x * x).sum(axis=1), 0, None))
    return np.concatenate([x, more[:, None]], axis=1)


def best_of_block(q_rows: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of each query by exact scores, which don't depend on a row's place: (query's place, score, row's place), flat."""
    who, score, place = [], [], []
    wide = k + MARGIN
    for i in range(0, len(q), 256):
        part, own = q[i : i + 256], q_rows[i : i + 256]
        with np.errstate(over="ignore", invalid="ignore"):
            s = np.nan_to_num(part @ x.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        s[own[:, None] == rows[None, :]] = -np.inf
        if s.shape[1] > wide:
            near = np.argpartition(s, -wide, axis=1)[:, -wide:]
            least = np.partition(np.take_along_axis(s, near, axis=1), -k, axis=1)[:, -k]
            # Where more rows than these come near the k-th score, all that do are looked at.
            with np.errstate(invalid="ignore"):
                floor = least - 1e-9 * (1 + np.abs(least))
            crowded = (s >= floor[:, None]).sum(axis=1) > wide
        else:
            near, crowded = np.tile(np.arange(s.shape[1]), (len(s), 1)), np.zeros(len(s), dtype=bool)
        with np.errstate(over="ignore", invalid="ignore"):
            exact = (x[near] * part[:, None, :]).sum(axis=2)
        exact[rows[near] == own[:, None]] = -np.inf
        order = np.lexsort((rows[near], ids[near], -exact), axis=-1)[:, :k]
        exact, near = np.take_along_axis(exact, order, axis=1), np.take_along_axis(near, order, axis=1)
        good = (rows[near] != own[:, None]) & ~crowded[:, None]
        r = np.nonzero(good)[0]
        who.append(r + i)
        score.append(exact[good])
        place.append(near[good])
        for r in np.flatnonzero(crowded).tolist():
            at = np.flatnonzero((s[r] >= floor[r]) & (rows != own[r]))
            with np.errstate(over="ignore", invalid="ignore"):
                exact_r = (x[at] * part[r]).sum(axis=1)
            best = np.lexsort((rows[at], ids[at], -exact_r))[:k]
            who.append(np.full(len(best), i + r))
            score.append(exact_r[best])
            place.append(at[best])
    return np.concatenate(who), np.concatenate(score), np.concatenate(place)


def _matrix(col: pa.Array, dtype: str) -> np.ndarray:
    raw = np.frombuffer(b"".join(col.to_pylist()), dtype=dtype)
    return raw.reshape(len(col), -1).astype(np.float64)


def stored(vectors: DataFrame) -> str:
    """Vectors travel as bytes of the column's own precision; products are made in doubles."""
    return "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"


def valid_vectors(vectors: DataFrame, is_query: Column) -> DataFrame:
    """vec_id, embedding -> row (a number of its own), vec_id, asked, vec (bytes), most (largest component), dims."""
    dtype = stored(vectors)
    asked = F.coalesce(is_query, F.lit(False))
    d = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), asked.alias("asked"), F.col("embedding").cast("array<double>").alias("embedding"))
    d = d.filter("vec_id is not null and size(embedding) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(3)
            flat, at = col.values, col.offsets.to_numpy()
            value = flat.to_numpy(zero_copy_only=False)  # nulls become NaN
            keep, vecs, most, dims = [], [], [], []
            for i in range(len(b)):
                x = value[at[i] : at[i + 1]]
                if np.isfinite(x).all() and x.any():
                    keep.append(i)
                    vecs.append(x.astype(dtype).tobytes())
                    most.append(float(np.abs(x).max()))
                    dims.append(len(x))
            kept = b.select(["row", "vec_id", "asked"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(vecs, pa.binary()), pa.array(most, pa.float64()), pa.array(dims, pa.int32())], ["row", "vec_id", "asked", "vec", "most", "dims"])

    return d.mapInArrow(run, "row long, vec_id long, asked boolean, vec binary, most double, dims int")


def exact_neighbours(base: DataFrame, q_rows: np.ndarray, q: np.ndarray, k: int, dtype: str) -> list[list[bytes]]:
    """The vectors of each query's k nearest rows, by one pass over all rows; a few queries only."""
    asked = base.sparkSession.sparkContext.broadcast((q_rows, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_q, x = asked.value
        best: list[list[tuple[float, int, int, bytes]]] = [[] for _ in rows_q]
        for b in batches:
            for i in range(0, len(b), BLOCK):
                part = b.slice(i, BLOCK)
                rows, ids = part.column(0).to_numpy(), part.column(1).to_numpy()
                who, score, place = best_of_block(rows_q, x, rows, ids, _matrix(part.column(2), dtype), k)
                for j, s, p in zip(who.tolist(), score.tolist(), place.tolist()):
                    best[j].append((-s, int(ids[p]), int(rows[p]), part.column(2)[p].as_py()))
                best = [sorted(found)[:k] for found in best]
        n = [j for j, found in enumerate(best) for _ in found]
        flat = [f for found in best for f in found]
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array([f[0] for f in flat], pa.float64()), pa.array([f[1] for f in flat], pa.int64()), pa.array([f[2] for f in flat], pa.int64()), pa.array([f[3] for f in flat], pa.binary())], ["n", "s", "v", "r", "vec"])

    found = base.select("row", "vec_id", "vec").mapInArrow(run, "n int, s double, v long, r long, vec binary")
    found = found.groupBy("n").agg(F.slice(F.array_sort(F.collect_list(F.struct("s", "v", "r", "vec"))), 1, k).alias("near"))
    out: list[list[bytes]] = [[] for _ in q_rows]
    for r in found.collect():
        out[r["n"]] = [bytes(x["vec"]) for x in r["near"]]
    return out


def probes_for(forest: Forest, q: np.ndarray, near: list[np.ndarray], hold: float) -> int:
    """The least number of probes with which the queries find the share ``hold`` of their exact neighbours."""
    total = forest.n_trees << forest.depth
    needed = []
    for x, rows in zip(q, near):
        if not len(rows):
            continue
        tree, node = forest.search(x[None], total)
        place = np.empty((forest.n_trees, 1 << forest.depth), dtype=np.int64)
        place[tree[0], node[0]] = np.arange(1, total + 1)
        # A row is found with the first of its leaves. Each query weighs the same.
        needed += [(int(p), 1 / len(rows)) for p in place[np.arange(forest.n_trees), forest.leaves(rows)].min(axis=1)]
    if not needed:
        return 1
    at, weight = np.array([p for p, _ in needed]), np.array([w for _, w in needed])
    order = np.argsort(at, kind="stable")
    share = np.cumsum(weight[order]) / weight.sum()
    return int(at[order][min(np.searchsorted(share, hold - 1e-12), len(order) - 1)])


def fitted(v: DataFrame, dtype: str, k: int, trees: int, probes: int | None, leaf: int, sample: int, hold: float) -> tuple[Forest, float, float, int, int]:
    """Of vectors of one length: the forest, the largest component and (scaled) norm, the probes, and the number of rows."""
    n, most = v.agg(F.count(F.lit(1)), F.max("most")).first()
    # A bounded sample, the same at each run.
    drawn = v.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(sample).select("vec").toArrow().column(0).combine_chunks()

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(0), dtype) / most
            yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((x * x).sum(axis=1)).max(initial=0.0))])], ["norm"])

    norm_max = v.select("vec").mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0]
    points = augment(_matrix(drawn, dtype) / most, norm_max)
    depth = 0
    while n > leaf << depth and len(points) >= LEAST_SAMPLE << (depth + 1):
        depth += 1
    forest = Forest(points, trees, depth)
    if probes is None:
        probes = trees
        trial = v.filter("asked").orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id", "row").limit(TRIALS).select("row", "vec").toArrow().combine_chunks()
        if len(trial) and probes < trees << depth:
            q = _matrix(trial.column(1).combine_chunks(), dtype)
            found = exact_neighbours(v, trial.column(0).to_numpy(), q, k, dtype)
            near = [augment(np.frombuffer(b"".join(f), dtype=dtype).reshape(len(f), -1).astype(np.float64) / most, norm_max) if f else np.zeros((0, 0)) for f in found]
            q = augment(q / most, norm_max, query=True)
            tried = []
            for d in range(max(0, depth - 5), depth + 1):
                needed = max(min(trees, trees << d), probes_for(forest.cut(d), q, near, hold))
                tried.append((needed * (n / (1 << d) + VISIT), d, needed))
            _, depth, probes = min(tried)
            forest = forest.cut(depth)
    return forest, most, norm_max, probes, n


_FILED = "cell long, row long, id long, vec binary"


def meet(rows: DataFrame, asked: DataFrame, dtype: str, k: int) -> DataFrame:
    """Filed rows and queries (cell, row, id, vec) -> query, query_id, s, v, row: the k best of each block for each query."""
    spark = rows.sparkSession
    # One count a leaf; leaves are bounded by the sample.
    sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocks = F.broadcast(checkpoint(sizes))
    filed = rows.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("row"), "blocks").cast("int").alias("block"), F.lit(0).alias("side"), "row", "id", "vec")
    met = asked.join(blocks, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "row", "id", "vec")
    met = filed.unionByName(met).repartition(shuffle_partitions(spark), "cell", "block").sortWithinPartitions("cell", "block", "side", "row")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, loaded = None, [], None
        for b in batches:
            key = np.stack([b.column(i).to_numpy() for i in range(3)])
            edges = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(b)]):
                if hi <= lo:
                    continue
                if tuple(key[:2, lo]) != now:
                    now, held, loaded = tuple(key[:2, lo]), [], None
                part = b.slice(lo, hi - lo)
                own = part.column(3).to_numpy(), part.column(4).to_numpy(), _matrix(part.column(5), dtype)
                if key[2, lo] == 0:
                    held.append(own)
                    continue
                if not held:
                    continue
                if loaded is None:
                    loaded = [np.concatenate(c) for c in zip(*held)]
                who, score, place = best_of_block(own[0], own[2], *loaded, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[0][who]), pa.array(own[1][who]), pa.array(score), pa.array(loaded[1][place]), pa.array(loaded[0][place])], ["query", "query_id", "s", "v", "row"]
                )

    return met.mapInArrow(rerank, "query long, query_id long, s double, v long, row long")


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, each row once: query, query_id, rank, vec_id, score."""
    found = found.repartition(shuffle_partitions(found.sparkSession), "query").sortWithinPartitions("query")

    def top(q: np.ndarray, q_id: np.ndarray, s: np.ndarray, v: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((row, v, -s, q))
        q, q_id, s, v, row = (x[order] for x in (q, q_id, s, v, row))
        first = np.ones(len(q), dtype=bool)
        # A row has the same score in every tree, so its repeats stand side by side.
        first[1:] = (q[1:] != q[:-1]) | (row[1:] != row[:-1])
        q, q_id, s, v = (x[first] for x in (q, q_id, s, v))
        start = np.searchsorted(q, q)
        rank = np.arange(len(q)) - start + 1
        near = rank <= k
        return pa.RecordBatch.from_arrays([pa.array(x[near]) for x in (q, q_id, rank.astype(np.int32), v, s)], ["query", "query_id", "rank", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            if not len(b):
                continue
            now = [c.to_numpy() for c in b.columns]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            last = int(np.searchsorted(now[0], now[0][-1]))  # the last query may go on
            if last:
                yield top(*(x[:last] for x in now))
            held = [x[last:] for x in now]
        if held is not None:
            yield top(*held)

    return found.mapInArrow(run, "query long, query_id long, rank int, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = K, trees: int = TREES, probes: int | None = None, leaf: int = LEAF, sample: int = SAMPLE, hold: float = HOLD) -> DataFrame:
    """vec_id, embedding -> query_id, rank, vec_id, score. ``probes``: leaves a query visits; measured, if none are given."""
    spark = vectors.sparkSession
    v, dtype = checkpoint(valid_vectors(vectors, is_query)), stored(vectors)
    out = None
    for r in v.groupBy("dims").count().orderBy("dims").collect():
        one = _nearest(v.filter(F.col("dims") == r["dims"]), dtype, k, trees, probes, leaf, sample, hold)
        out = one if out is None else out.union(one)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _nearest(v: DataFrame, dtype: str, k: int, trees: int, probes: int | None, leaf: int, sample: int, hold: float) -> DataFrame:
    forest, most, norm_max, probes, n = fitted(v, dtype, k, trees, probes, leaf, sample, hold)
    shared = v.sparkSession.sparkContext.broadcast(forest)  # SAMPLE / LEAST_SAMPLE planes a tree at most

    def file_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            at = shared.value.leaves(augment(_matrix(b.column(2), dtype) / most, norm_max))
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array(at[:, t] * trees + t), *b.columns], ["cell", "row", "id", "vec"])

    def file_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, min(512, 50_000 // probes))
            for i in range(0, len(b), step):
                part = b.slice(i, step)
                tree, node = shared.value.search(augment(_matrix(part.column(2), dtype) / most, norm_max, query=True), probes)
                who = pa.array(np.repeat(np.arange(len(part)), tree.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array((node * trees + tree).ravel()), *(c.take(who) for c in part.columns)], ["cell", "row", "id", "vec"])

    base = v.select("row", "vec_id", "vec")
    asked = v.filter("asked").select("row", "vec_id", "vec")
    found = checkpoint(merged(meet(base.mapInArrow(file_rows, _FILED), asked.mapInArrow(file_queries, _FILED), dtype, k), k))
    # Where leaves hold few rows, a query can end with fewer than there are.
    enough = found.filter(F.col("rank") == min(k, n - 1)).select(F.col("query").alias("row"))
    short = checkpoint(asked.join(enough, "row", "left_anti"))
    if n > 1 and not short.isEmpty():
        every = lambda d: d.select(F.lit(0).cast("long").alias("cell"), "row", F.col("vec_id").alias("id"), "vec")
        whole = merged(meet(every(base), every(short), dtype, k), k)
        found = found.join(short.select(F.col("row").alias("query")), "query", "left_anti").unionByName(whole)
    return found.select("query_id", "rank", "vec_id", "score")
