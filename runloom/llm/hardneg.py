"""Hard negatives by ball trees, searched with bounds on both sides.

1. Vectors become integers, floor(256 x), and rows are filed in cells around pivots, which k-means finds on a bounded
   sample. A cell is dealt out in units of about 8 sqrt(n) rows (512 to 16,384), however many rows it has, by
   a hash, so that a crowded cell is many units.
2. A task builds a ball tree on one unit at a time: a node is cut at the median between two far points, and
   knows its centre, radius and labels. Anchors stream past it in batches. For a query q and a node, inner
   products lie between q c - |q| r and q c + |q| r. A node is left out if its labels can't serve, if these bounds miss
   all of the anchor's score windows, or if the upper one is strictly beneath the current k-th score.
3. The cells are balls as well, so the same bounds tell which cells an anchor need not visit. Each anchor first goes to the
   HOME cells of the greatest products; its k-th scores there are floors for a second round over all others.
4. Positives are one open window over rows of the anchor's label. Each of them then makes a window for
   negatives: 80 p <= 100 n <= 100 p, which is p - floor(p / 5) <= n <= p. All windows of an anchor are searched at once.

Scores are integers and exact: products are made in doubles where all sums stay below 2^53, and else in 64-bit integers. The search
leaves nothing out. On vectors without structure the bounds prune little, and work is near anchors times rows, in blocks.

Cases: rows with a null label, vector or id take no part, nor do rows with a null or non-finite component, or with a squared norm of
2^62 or more (whose scores need not fit a long). Vectors of each length are a table of their own. Rows are told apart by
a number, so repeated rows are each other's candidates, and repeated anchors are mined each. Ties go to the smaller id, then
to the earlier row. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import checkpoint, shuffle_partitions

K = 5
SAMPLE = 8192
LEAF = 128
HOME = 2
#: Cells at most, and the most bytes that their pivots may take on the driver and in each task.
CELLS, PIVOT_BYTES = 1024, 16 << 20
#: Anchors that meet a tree together.
BATCH = 256
#: Below all scores and above all.
LOW, HIGH = -(1 << 62), 1 << 62


def matrix(col: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype="<i4").reshape(len(col), width)


class BallTree:
    """Nodes in an array: node i covers rows lo[i] to hi[i] of the reordered points; leaves have no children."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> None:
        f = x.astype(np.float64)
        order = np.arange(len(x))
        self.lo, self.hi, self.below, center, radius, least, most = [], [], [], [], [], [], []
        todo = [(0, len(x))]
        while len(self.lo) < len(todo):
            lo, hi = todo[len(self.lo)]
            at = order[lo:hi]
            part = f[at]
            c = part.mean(axis=0)
            center.append(c)
            radius.append(float(np.sqrt(((part - c) ** 2).sum(axis=1).max())))
            least.append(labels[at].min())
            most.append(labels[at].max())
            self.lo.append(lo)
            self.hi.append(hi)
            if hi - lo <= leaf:
                self.below.append(None)
                continue
            a = part[((part - c) ** 2).sum(axis=1).argmax()]
            b = part[((part - a) ** 2).sum(axis=1).argmax()]
            mid = (hi - lo) // 2
            order[lo:hi] = at[np.argpartition(part @ (b - a), mid)]
            self.below.append((len(todo), len(todo) + 1))
            todo += [(lo, lo + mid), (lo + mid, hi)]
        self.center, self.radius = np.array(center), np.array(radius)
        self.least, self.most = np.array(least), np.array(most)
        self.x, self.ids, self.rows, self.labels = x[order], ids[order], rows[order], labels[order]
        self.norm = float(np.sqrt((f * f).sum(axis=1).max()))
        self.size = np.sqrt((self.center**2).sum(axis=1)) + self.radius


def bounds(q: np.ndarray, norm: np.ndarray, center: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greatest and least inner products of queries with balls; a little wide, for rounding."""
    dot = q @ center.T
    reach = norm[:, None] * radius[None, :]
    slack = 1e-9 * (1 + norm[:, None] * (np.sqrt((center * center).sum(axis=1)) + radius)[None, :])
    return dot + reach + slack, dot - reach - slack


class Found:
    """The k best rows of each (query, window) so far."""

    def __init__(self, floor: np.ndarray, k: int) -> None:
        n, self.k = floor.size, k
        self.floor = floor.ravel()
        self.score, self.id, self.row = np.full((n, k), LOW), np.zeros((n, k), np.int64), np.full((n, k), -1)
        self.kth = self.floor.copy()

    def add(self, pair: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        seen, k = np.unique(pair), self.k
        held = self.row[seen] >= 0
        pair = np.concatenate([np.repeat(seen, held.sum(axis=1)), pair])
        score = np.concatenate([self.score[seen][held], score])
        ids, rows = np.concatenate([self.id[seen][held], ids]), np.concatenate([self.row[seen][held], rows])
        order = np.lexsort((rows, ids, -score, pair))
        pair, score, ids, rows = (v[order] for v in (pair, score, ids, rows))
        place = np.arange(len(pair)) - np.searchsorted(pair, pair)
        best = place < k
        at = pair[best], place[best]
        self.score[at], self.id[at], self.row[at] = score[best], ids[best], rows[best]
        full = self.row[seen, k - 1] >= 0
        self.kth[seen[full]] = np.maximum(self.floor[seen[full]], self.score[seen[full], k - 1])


def search(tree: BallTree, q: np.ndarray, q_rows: np.ndarray, q_labels: np.ndarray, lo: np.ndarray, hi: np.ndarray, floor: np.ndarray, same: bool, k: int = K) -> tuple[Found, int]:
    """Branch and bound for a batch of queries, whose windows lo..hi and floors are (queries, windows); also how many products it made."""
    found, made, width = Found(floor, k), 0, lo.shape[1]
    qf = q.astype(np.float64)
    norm = np.sqrt((qf * qf).sum(axis=1))
    up, down = bounds(qf, norm, tree.center, tree.radius)
    exact = norm.max(initial=0) * tree.norm < 2**52
    todo = [(0, np.arange(len(q)))]
    while todo:
        node, who = todo.pop()
        kth = found.kth.reshape(lo.shape)[who]
        # A window that is above its own end is empty.
        open_ = (up[who, node, None] >= np.maximum(lo[who], kth)) & (down[who, node, None] <= hi[who]) & (lo[who] <= hi[who])
        one = tree.least[node] == tree.most[node]
        serves = (q_labels[who] >= tree.least[node]) & (q_labels[who] <= tree.most[node]) if same else ~(one & (q_labels[who] == tree.least[node]))
        who = who[open_.any(axis=1) & serves]
        if not len(who):
            continue
        if tree.below[node] is not None:
            # The child with the greater products comes first, so that the k-th scores rise early.
            todo += [(c, who) for c in sorted(tree.below[node], key=lambda c: up[who, c].sum())]
            continue
        part = slice(tree.lo[node], tree.hi[node])
        x = tree.x[part]
        s = (qf[who] @ x.T.astype(np.float64)).astype(np.int64) if exact else q[who].astype(np.int64) @ x.T.astype(np.int64)
        made += s.size
        ok = (q_labels[who][:, None] == tree.labels[part][None, :]) == same
        ok &= q_rows[who][:, None] != tree.rows[part][None, :]
        kth = found.kth.reshape(lo.shape)
        for w in range(width):
            i, j = np.nonzero(ok & (s >= np.maximum(lo[who, w], kth[who, w])[:, None]) & (s <= hi[who, w][:, None]))
            if len(i):
                found.add(who[i] * width + w, s[i, j], tree.ids[part][j], tree.rows[part][j])
    return found, made


def valid_rows(vectors: DataFrame, is_anchor: Column, label: Column) -> DataFrame:
    """vec_id, embedding -> row, id, label, anchor, vec (integers as bytes), dims."""
    d = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("x")
    ).filter("id is not null and label is not null and x is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(4)
            flat, at = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()  # nulls become NaN
            keep, vecs, dims = [], [], []
            for i in range(len(b)):
                x = flat[at[i] : at[i + 1]]
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):
                    q = np.floor(256 * x)
                    fits = float((q * q).sum()) < HIGH * (1 - 1e-9)
                if fits:
                    keep.append(i)
                    vecs.append(q.astype("<i4").tobytes())
                    dims.append(len(x))
            kept = b.select(["row", "id", "label", "anchor"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(vecs, pa.binary()), pa.array(dims, pa.int32())], ["row", "id", "label", "anchor", "vec", "dims"])

    return d.mapInArrow(run, "row long, id long, label long, anchor boolean, vec binary, dims int")


def pivots_of(sample: np.ndarray, n: int, rounds: int = 4, seed: int = 3) -> np.ndarray:
    """k-means on a sample."""
    p = sample[np.random.default_rng(seed).choice(len(sample), n, replace=False)]
    for _ in range(rounds):
        near = nearest_pivot(sample, p)[0]
        for i in range(n):
            if (near == i).any():
                p[i] = sample[near == i].mean(axis=0)
    return p


def nearest_pivot(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = ((pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T)).argmin(axis=1)
    return near, np.sqrt(((x - pivots[near]) ** 2).sum(axis=1))


class Cells:
    """The table in cells and units. ``pivots``, ``radius``, ``units`` and ``first`` have a row for each cell, CELLS at most."""

    def __init__(self, v: DataFrame, dims: int) -> None:
        n = v.count()
        self.rows_a_unit = int(np.clip(8 * np.sqrt(n), 512, 16_384))
        drawn = v.orderBy(F.xxhash64("id"), "id", "row").limit(SAMPLE).select("vec").toArrow().column(0).combine_chunks()
        sample = matrix(drawn, dims).astype(np.float64)
        count = max(1, min(CELLS, PIVOT_BYTES // (8 * dims + 8), 2 * n // self.rows_a_unit, len(sample) // 4))
        pivots = self.pivots = pivots_of(sample, count)

        def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    near, far = nearest_pivot(matrix(b.column(4), dims).astype(np.float64), pivots)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(far)], ["row", "id", "label", "anchor", "vec", "cell", "far"])

        self.rows = checkpoint(v.select("row", "id", "label", "anchor", "vec").mapInArrow(file, "row long, id long, label long, anchor boolean, vec binary, cell int, far double"))
        self.radius, self.units = np.zeros(count), np.zeros(count, dtype=np.int64)
        for r in self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():
            self.radius[r["cell"]], self.units[r["cell"]] = r["far"] * (1 + 1e-9), -(-r["n"] // self.rows_a_unit)
        self.first = np.cumsum(self.units) - self.units

    def dealt(self, spark: SparkSession) -> DataFrame:
        """The rows with their unit."""
        units = spark.createDataFrame([(i, int(u), int(f)) for i, (u, f) in enumerate(zip(self.units, self.first))], "cell int, units long, first long")
        return self.rows.join(F.broadcast(units), "cell").select((F.col("first") + F.pmod(F.xxhash64("row"), "units")).alias("unit"), "row", "id", "label", "vec")


ASKED = "row long, id long, label long, vec binary, lo binary, hi binary, floor binary"


def routed(asked: DataFrame, cells: Cells, dims: int, home: bool) -> DataFrame:
    """Anchors, once for each unit they visit: of their HOME cells, or of all others that their bounds don't rule out."""
    pivots, radius, units, first = cells.pivots, cells.radius, cells.units, cells.first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), BATCH):
                b = whole.slice(i, BATCH)
                q = matrix(b.column(3), dims).astype(np.float64)
                up, down = bounds(q, np.sqrt((q * q).sum(axis=1)), pivots, radius)
                lo, hi, floor = (windows(b.column(c)) for c in (4, 5, 6))
                visit = np.zeros(up.shape, dtype=bool)
                for w in range(lo.shape[1]):
                    visit |= (up >= np.maximum(lo[:, w], floor[:, w])[:, None]) & (down <= hi[:, w][:, None]) & (lo[:, w] <= hi[:, w])[:, None]
                near = np.argsort(-(q @ pivots.T), axis=1, kind="stable")[:, :HOME]
                first_ones = np.zeros(up.shape, dtype=bool)
                np.put_along_axis(first_ones, near, True, axis=1)
                who, cell = np.nonzero(visit & (first_ones if home else ~first_ones) & (units > 0)[None, :])
                n = units[cell]
                unit = np.repeat(first[cell], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(who, n)
                for j in range(0, len(at), 4096):
                    rows = b.take(pa.array(at[j : j + 4096]))
                    yield pa.RecordBatch.from_arrays([pa.array(unit[j : j + 4096]), *rows.columns], ["unit", *rows.schema.names])

    return asked.mapInArrow(run, "unit long, " + ASKED)


def windows(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype="<i8").reshape(len(col), -1)


def meet(dealt: DataFrame, asked: DataFrame, n_units: int, dims: int, same: bool, k: int) -> DataFrame:
    """Units and their anchors -> the k best rows of each unit for each window: row, window, score, found_id, found_row."""
    none = F.lit(None).cast("binary")
    both = dealt.select("unit", F.lit(0).alias("side"), "row", "id", "label", "vec", none.alias("lo"), none.alias("hi"), none.alias("floor"))
    both = both.unionByName(asked.withColumn("side", F.lit(1)))
    # Units are dealt in turn, eight to a task at most, and a task holds one at a time.
    n = max(1, min(n_units, max(shuffle_partitions(dealt.sparkSession), -(-n_units // 8))))
    both = both.withColumn("_to", (F.col("unit") % n).cast("int")).repartitionById(n, "_to").sortWithinPartitions("unit", "side", "row").drop("_to")
    names = ["row", "window", "score", "found_id", "found_row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tree = None, [], None
        for b in batches:
            unit, side = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero((unit[1:] != unit[:-1]) | (side[1:] != side[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(b)]):
                if hi <= lo:
                    continue
                if unit[lo] != now:
                    now, held, tree = unit[lo], [], None
                part = b.slice(lo, hi - lo)
                row, ids, label = (part.column(c).to_numpy() for c in (2, 3, 4))
                x = matrix(part.column(5), dims)
                if side[lo] == 0:
                    held.append((x, ids, row, label))
                    continue
                if not held:
                    continue
                if tree is None:
                    tree, held = BallTree(*(np.concatenate(c) for c in zip(*held))), [()]
                for i in range(0, len(row), BATCH):
                    s = slice(i, i + BATCH)
                    lo_, hi_, floor = (windows(part.column(c).slice(i, BATCH)) for c in (6, 7, 8))
                    found, _ = search(tree, x[s], row[s], label[s], lo_, hi_, floor, same, k)
                    at, place = np.nonzero(found.row >= 0)
                    width = lo_.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(row[s][at // width]), pa.array((at % width).astype(np.int32)), pa.array(found.score[at, place]), pa.array(found.id[at, place]), pa.array(found.row[at, place])], names)

    return both.mapInArrow(run, "row long, window int, score long, found_id long, found_row long")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each window, with their rank from 1."""
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "found_id", "found_row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def as_bytes(asked: DataFrame, windows_of: str) -> DataFrame:
    """row, id, label, vec and two arrays -> lo, hi, floor as bytes. ``windows_of``: 'all' or 'positives' (whose scores are given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo, hi, floor = [], [], []
            for scores, floors in zip(b.column(4).to_pylist(), b.column(5).to_pylist()):
                p = np.array(scores, dtype=np.int64)
                f = np.full(len(p), LOW)
                for w, x in floors or []:
                    f[w] = x
                lo.append((np.full(1, LOW) if windows_of == "all" else p - p // 5).astype("<i8").tobytes())
                hi.append((np.full(1, HIGH) if windows_of == "all" else p).astype("<i8").tobytes())
                floor.append(f.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array(c, pa.binary()) for c in (lo, hi, floor))], ["row", "id", "label", "vec", "lo", "hi", "floor"])

    return asked.select("row", "id", "label", "vec", "scores", F.transform("floors", lambda x: F.array(x["window"].cast("long"), x["score"])).alias("floors")).mapInArrow(run, ASKED)


def searched(cells: Cells, dealt: DataFrame, asked: DataFrame, dims: int, same: bool, k: int) -> DataFrame:
    """asked: row, id, label, vec, scores. Two rounds; the first one's k-th scores are floors of the second."""
    kind, n = "all" if same else "positives", int(cells.units.sum())
    none = F.lit(None).cast("array<struct<window:int,score:long>>")
    near = checkpoint(best(meet(dealt, routed(as_bytes(asked.withColumn("floors", none), kind), cells, dims, True), n, dims, same, k), k))
    floors = near.filter(F.col("rank") == k).groupBy("row").agg(F.collect_list(F.struct("window", "score")).alias("floors"))  # one a window
    rest = routed(as_bytes(asked.join(floors, "row", "left"), kind), cells, dims, False)
    return best(near.drop("rank").unionByName(meet(dealt, rest, n, dims, same, k)), k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, k: int = K) -> DataFrame:
    """vec_id, embedding -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    v, out = checkpoint(valid_rows(vectors, is_anchor, label)), None
    for r in v.groupBy("dims").count().orderBy("dims").collect():
        one = _mined(v.filter(F.col("dims") == r["dims"]), r["dims"], k)
        out = one if out is None else out.unionByName(one)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame([], schema) if out is None else out


def _mined(v: DataFrame, dims: int, k: int) -> DataFrame:
    cells = Cells(v, dims)
    dealt = cells.dealt(v.sparkSession)
    anchors = cells.rows.filter("anchor").select("row", "id", "label", "vec")
    positives = checkpoint(searched(cells, dealt, anchors.withColumn("scores", F.array(F.lit(0).cast("long"))), dims, True, k))
    # k of each anchor at most.
    scores = positives.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p")).select("row", F.transform("p", lambda p: p["score"]).alias("scores"))
    negatives = searched(cells, dealt, anchors.join(scores, "row"), dims, False, k)
    pos = positives.select("row", (F.col("rank") - 1).alias("window"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = negatives.join(pos, ["row", "window"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return found.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
