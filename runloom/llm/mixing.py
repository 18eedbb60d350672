"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix has one seat a word; Sainte-Laguë gives the seats to the sources by highest
quotients target / (2 * seats + 1). As the method is house-monotone, quotas of
consecutive output shards are differences of apportionments of growing houses.
Each source's word stream is cut into blocks of BLOCK words, whatever the other sources
hold. A seeded permutation puts the blocks in a row, and the row is gone through again and
again: each of SHARDS output shards in turn takes as many words of it as its quota says. So a
quota of q words over a source of n takes each block q div n times, and the first blocks once more;
only blocks where a shard's quota ends are cut.

Everything is a DataFrame or SQL function. The quotients' threshold is found by
bisection over one row per source (source counts are metadata: one row each).
Document positions come from two levels of sums (hash cells, then inside a cell).
The permutation is arithmetic, so selecting needs no ranks over blocks.

Cases: a null source is a source of its own, last in order. A null or empty text
has size 0 and takes 0. Repeated rows count each. Sources of size 0 have the
target 0. Empty tables give empty results. Further input columns are ignored. A very long text is many
blocks; the work is linear in it. Ties between quotients go to the first source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, checkpoint, n_words, words

CELLS = 4096
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
#: Words in a block, of any source. The last block of a source may be shorter.
BLOCK = 1024
SHARDS = 8
#: Steps of the permutation: primes, so that one of them has no divisor in common with any block count.
STEPS = (536870909, 536870879)


def source_targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(skey, source, source_size) -> with rank, weight, target.

    The level at which weight * level, stopped at cap * size, sums up to the mix
    is what repeated resharing of the excess by weight ends in.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    s = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", weight)
    s = s.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    everything = Window.partitionBy()
    order = Window.orderBy("ratio", "rank")
    s = s.withColumn("mix", share * F.sum("source_size").over(everything))
    s = s.withColumn("stopped", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("mix") - F.col("stopped")) / F.col("open"))
    level = F.coalesce(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)["level"], F.max("ratio").over(everything))
    s = s.withColumn("chosen", level)
    return s.select("skey", "source", "source_size", "rank", "weight", "mix", F.least("most", F.col("chosen") * F.col("weight")).alias("target"))


def apportion(targets: Column, seats: Column) -> Column:
    """Sainte-Laguë: an array of seats for an array of targets (plain columns)."""
    total = F.aggregate(targets, F.lit(0.0), lambda a, t: a + t)
    given = lambda d: F.transform(targets, lambda t: F.floor(t / d + 0.5).cast("long"))
    sum_of = lambda d: F.aggregate(targets, F.lit(0).cast("long"), lambda a, t: a + F.floor(t / d + 0.5).cast("long"))
    first = F.struct((total / (seats + F.size(targets) + 1)).alias("lo"), (2 * total + 1).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        return F.when(sum_of(mid) > seats, F.struct(mid.alias("lo"), s["hi"].alias("hi"))).otherwise(
            F.struct(s["lo"].alias("lo"), mid.alias("hi"))
        )

    divisor = F.aggregate(F.sequence(F.lit(1), F.lit(90)), first, halve)["hi"]
    base = given(divisor)
    # Seats that are left are ties at the divisor: the highest next quotients get them, the first source first.
    left = seats - F.aggregate(base, F.lit(0).cast("long"), lambda a, n: a + n)
    quotients = F.transform(F.arrays_zip(targets.alias("t"), base.alias("n")), lambda x, i: F.struct((-x["t"] / (2 * x["n"] + 1)).alias("q"), i.alias("i"), x["n"].alias("n")))
    return F.transform(F.sort_array(quotients), lambda x, i: F.struct(x["i"].alias("i"), (x["n"] + F.when(i < left, 1).otherwise(0)).alias("seats")))


def quotas(targets: DataFrame, seed: int, n_shards: int = SHARDS) -> DataFrame:
    """One row a source: block size, blocks, seats (words), its permutation, and ``until``: the seats of the first k shards together."""
    row = targets.agg(
        F.sort_array(F.collect_list(F.struct("rank", "target", "skey", "source", "source_size"))).alias("s"),
        F.max("mix").alias("mix"),
    ).filter(F.size("s") > 0)
    row = row.withColumn("block", F.lit(BLOCK).cast("long")).withColumn("house", F.round("mix").cast("long")).withColumn("t", F.transform("s", lambda x: x["target"]))
    houses = row.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_shards))).alias("k")).withColumn("seats", F.floor(F.col("house") * F.col("k") / n_shards).cast("long"))
    given = houses.select("block", "k", "s", F.explode(apportion(F.col("t"), F.col("seats"))).alias("g"))
    given = given.select("block", "k", F.element_at("s", (F.col("g.i") + 1).cast("int")).alias("x"), F.col("g.seats").alias("seats"))
    given = given.groupBy("x", "block").agg(F.sort_array(F.collect_list(F.struct("k", "seats"))).alias("by_house"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("x.source_size") / F.col("block"))).cast("long")
    most = (2 * F.col("x.source_size")).cast("long")
    return given.select(
        F.col("x.skey").alias("skey"),
        F.col("x.source").alias("source"),
        F.col("x.source_size").alias("source_size"),
        F.col("x.target").alias("target"),
        "block",
        blocks.alias("blocks"),
        F.least(F.element_at("by_house", -1)["seats"], most).alias("seats"),
        F.transform("by_house", lambda y: F.least(y["seats"], most)).alias("until"),
        F.when(blocks % STEPS[0] != 0, F.lit(STEPS[0])).otherwise(F.lit(STEPS[1])).cast("long").alias("step"),
        F.pmod(F.xxhash64(F.col("x.skey"), F.lit(seed)), blocks).alias("shift"),
    )


def before(block: Column) -> Column:
    """The words of the blocks that come before one in the permuted row."""
    drawn = lambda b: F.pmod(F.col("step") * b + F.col("shift"), F.col("blocks"))
    last = F.col("blocks") - 1
    short = F.col("blocks") * F.col("block") - F.col("source_size")
    return drawn(block) * F.col("block") - F.when(drawn(block) > drawn(last), short).otherwise(0)


def mix(docs: DataFrame, seed: int = 17, n_shards: int = SHARDS, keep: list[str] | None = None) -> DataFrame:
    """doc_id, source, text -> doc_id, size, source, source_size, target, taken, pieces.

    ``pieces``: (shard, turn, first word, end) inside the document, for each part of a block that
    lies in it and that a shard takes, by turn and first word. ``keep``: further columns to carry along.
    """
    keep = keep or []
    d = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("skey"),
        n_words(F.col("text").cast("string")).alias("size"),
        F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(CELLS)).cast("int").alias("cell"),
        *keep,
    )
    d = checkpoint(d)
    by_cell = d.groupBy("skey", "source", "cell").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("skey").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = by_cell.select("skey", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    sizes = by_cell.groupBy("skey", "source").agg(F.sum("n").alias("source_size"))
    plan = quotas(source_targets(sizes), seed, n_shards).drop("source")
    inside = Window.partitionBy("skey", "cell").orderBy(F.xxhash64("doc_id"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("stop", F.sum("size").over(inside)).join(cells, ["skey", "cell"])
    # One row a source; left to the planner, as nothing bounds how many sources there are.
    d = d.join(plan, "skey").withColumn("start", F.col("first") + F.col("stop") - F.col("size"))
    blocks = F.when(
        F.col("size") > 0,
        F.sequence(F.floor(F.col("start") / F.col("block")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block"))),
    ).otherwise(F.array().cast("array<bigint>"))

    def pieces(turn: int) -> Column:
        """Of each block, the document's part, by the shards in whose stretch of the row it falls."""

        def of(b: Column) -> Column:
            lo = F.greatest(b * F.col("block"), "start")
            hi = F.least((b + 1) * F.col("block"), F.col("start") + F.col("size"))
            # Word w of the stream (from 0) stands at w + away in the row.
            away = F.lit(turn) * F.col("source_size") + before(b) - b * F.col("block")
            cut = lambda u, k: F.struct(
                k.cast("int").alias("shard"), F.lit(turn).alias("turn"),
                (F.greatest(lo, F.when(k > 0, F.get("until", k - 1)).otherwise(0) - away) - F.col("start")).alias("first"),
                (F.least(hi, u - away) - F.col("start")).alias("end"),
            )
            return F.when(lo + away < F.col("seats"), F.filter(F.transform("until", cut), lambda p: p["end"] > p["first"])).otherwise(
                F.array().cast("array<struct<shard:int,turn:int,first:bigint,end:bigint>>")
            )

        return F.flatten(F.transform(blocks, of))

    d = d.withColumn("pieces", F.concat(pieces(0), pieces(1)))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["end"] - p["first"])
    return d.select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"), "pieces", *keep)


def mix_documents(docs: DataFrame, seed: int = 17, n_shards: int = 1) -> DataFrame:
    """The documents that the mix consists of, with their own columns.

    With several shards a document is cut where its neighbouring blocks go to different ones. The rows don't say their shard,
    so there is one unless the caller asks for more.

    A document that is taken twice gives rows for either time. Parts of a document that a shard takes
    together and that follow each other stay together: a row holds the text of one such run, white space between its
    words included, and the whole text, unchanged, if the run covers the document. Documents without words have
    nothing to take and take no part.
    """
    packed = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    m = mix(packed, seed, n_shards, keep=["_row"]).select("_row", "size", F.explode(_runs(F.col("pieces"))).alias("run"))
    text = F.col("_row.text").cast("string")
    whole = (F.col("run.first") == 0) & (F.col("run.end") == F.col("size"))
    first, n = F.col("run.first").cast("int"), (F.col("run.end") - F.col("run.first")).cast("int")
    # The first field of this split is what stands before the first word; each later one follows a word.
    gaps = F.slice(F.split(text, WORD, -1), first + 2, n)
    both = F.zip_with(F.slice(words(text), first + 1, n), gaps, lambda w, g: F.concat(w, g))
    part = F.regexp_replace(F.array_join(both, ""), r"[\x20\x09-\x0D]+\z", "")
    text = F.when(whole, text).otherwise(part)
    out = m.select(F.col("_row"), text.alias("_text"))
    made = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[made[c].alias(c) if c in made else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def _runs(pieces: Column) -> Column:
    """Neighbouring pieces of a shard and turn joined: an array of (shard, first, end). ``pieces`` has to be a plain column."""
    joins = lambda a, b: F.coalesce((a["shard"] == b["shard"]) & (a["turn"] == b["turn"]) & (a["end"] == b["first"]), F.lit(False))
    begins = F.filter(pieces, lambda p, i: (i == 0) | ~joins(F.get(pieces, i - 1), p))
    ends = F.filter(pieces, lambda p, i: (i == F.size(pieces) - 1) | ~joins(p, F.get(pieces, i + 1)))
    return F.zip_with(begins, ends, lambda a, b: F.struct(a["shard"].alias("shard"), a["first"].alias("first"), b["end"].alias("end")))
