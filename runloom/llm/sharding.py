"""Minimax contiguous sharding.

Equal texts form a group. Groups are ordered by the digest of their text and
cut into contiguous shards so that the largest shard is as small as possible.
The capacity is found by binary search; each candidate is checked greedily.

The ordered atoms that are cut are digest cells: all groups whose digests agree
in their first ``CELL_BITS`` bits. Their number is fixed, so the search runs in
one bounded array whatever the input is, and copies never part. A shard exceeds
the optimum over single groups by one cell at most.

Everything is a DataFrame or SQL function. Slots are ranks by two levels
(counts of bounded hash bins, then ranks inside a bin), so no task holds a shard.

Cases: a null text has no bytes (size 1, crc 0) and forms one group that differs
from the empty text. Repeated rows get slots of their own. An empty table gives
an empty result. Further input columns are ignored. A group larger than an equal
share sets the capacity, and shards at the end may then stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import checkpoint

CELL_BITS = 14
SLOT_BINS = 1024


def minimax_capacity(sizes: Column, n_shards: int) -> Column:
    """The least capacity with which greedy filling needs ``n_shards`` at most.

    ``sizes``: array of long, in order. It has to be a plain column, since it is
    read in nested lambdas.
    """
    zero = F.lit(0).cast("long")
    total = F.aggregate(sizes, zero, lambda a, x: a + x)
    start = F.struct(F.greatest(F.array_max(sizes), F.ceil(total / n_shards).cast("long")).alias("lo"), total.alias("hi"))

    def shards_used(capacity: Column) -> Column:
        state = F.struct(F.lit(1).alias("n"), zero.alias("fill"))
        return F.aggregate(
            sizes,
            state,
            lambda a, x: F.when(a["fill"] + x > capacity, F.struct((a["n"] + 1).alias("n"), x.alias("fill"))).otherwise(
                F.struct(a["n"].alias("n"), (a["fill"] + x).alias("fill"))
            ),
        )["n"]

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("long")
        open_ = s["lo"] < s["hi"]
        fits = shards_used(mid) <= n_shards
        return F.when(~open_, s).when(
            fits, F.struct(s["lo"].alias("lo"), mid.alias("hi"))
        ).otherwise(F.struct((mid + 1).alias("lo"), s["hi"].alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(50)), start, halve)["hi"]


def greedy_cuts(sizes: Column, capacity: Column) -> Column:
    """The positions at which a new shard begins, the first left out."""
    zero = F.lit(0).cast("long")
    state = F.struct(zero.alias("i"), zero.alias("fill"), F.array().cast("array<long>").alias("cuts"))

    def step(a: Column, x: Column) -> Column:
        over = a["fill"] + x > capacity
        return F.struct(
            (a["i"] + 1).alias("i"),
            F.when(over, x).otherwise(a["fill"] + x).alias("fill"),
            F.when(over, F.concat(a["cuts"], F.array(a["i"]))).otherwise(a["cuts"]).alias("cuts"),
        )

    return F.aggregate(sizes, state, step)["cuts"]


def shard_cells(cells: DataFrame, n_shards: int) -> DataFrame:
    """(cell, bytes) -> (cell, shard). The cells are few: one array holds them."""
    row = cells.agg(F.sort_array(F.collect_list(F.struct("cell", "bytes"))).alias("cells"))
    row = row.select("cells", F.transform("cells", lambda c: c["bytes"]).alias("sizes")).filter(F.size("cells") > 0)
    row = row.select("cells", "sizes", minimax_capacity(F.col("sizes"), n_shards).alias("capacity"))
    row = row.select("cells", "capacity", greedy_cuts(F.col("sizes"), F.col("capacity")).alias("cuts"))
    return row.select("capacity", "cuts", F.posexplode("cells").alias("i", "c")).select(
        F.col("c.cell").alias("cell"),
        F.size(F.filter("cuts", lambda x: x <= F.col("i"))).alias("shard"),
        "capacity",
    )


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, text -> doc_id, size, text_crc32, shard, slot, capacity."""
    text = F.col("text").cast("string")
    digest = F.md5(text.cast("binary"))
    d = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(
            F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), 32 - CELL_BITS),
            F.lit((1 << CELL_BITS) - 1),
        ).cast("int").alias("cell"),
    )
    d = checkpoint(d)
    placed = shard_cells(d.groupBy("cell").agg(F.sum("size").alias("bytes")), n_shards)
    # The cells are 2^CELL_BITS at most: a bounded broadcast.
    d = d.join(F.broadcast(placed), "cell").withColumn(
        "bin", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLOT_BINS)).cast("int")
    )
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = d.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
    bins = bins.select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bin").orderBy("doc_id", "text_crc32", "size")
    # n_shards * SLOT_BINS rows: a bounded broadcast as well.
    return d.join(F.broadcast(bins), ["shard", "bin"]).select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.col("first") + F.row_number().over(inside) - 1).cast("long").alias("slot"),
        "capacity",
    )
