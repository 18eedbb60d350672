"""Quality by weak supervision.

Rules look at a document's figures and vote good (1) or bad (0), or abstain
(null). A generative model gives each rule one accuracy; expectation-maximisation
estimates the accuracies and the share of good documents from the votes alone.
The posterior probability of "good" then decides, in place of all rules having to pass.

Votes are counted by pattern: with R rules there are 3^R patterns at most, so the
estimation runs over one bounded array, inside a single SQL expression.
Everything is a DataFrame or SQL function.

Cases: a null or empty text has no words and fails the base rule. Repeated rows
are judged alike. An empty table gives an empty result. Other columns are ignored,
or kept as they are by ``keep_good``.

Three-word windows are compared by 64-bit hashes inside one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD, checkpoint, scratch, words

ROUNDS = 40
LEAST_WORDS = 50
THRESHOLD = 0.5
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_plain")


def figures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the figures of each text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    d = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias("_t"), words(text).alias("_w"), lines.alias("_l"))
    w = F.col("_w")
    n = F.size(w)
    three = F.transform(
        F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
    )
    d = d.withColumn("_h", three)
    # Only texts that have a window twice are sorted.
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    d = d.withColumn(
        "_s",
        F.when(twice, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(
            F.array().cast("array<struct<h:bigint,i:int>>")
        ),
    )
    s = F.col("_s")
    same = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.sequence(x["i"], x["i"] + 2)))))
    t = F.col("_t")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    return d.select(
        *[F.col(f"`{c}`") for c in keep],
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        count("[A-Z]").alias("n_upper"),
        (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long").alias("n_marks"),
        count(r"(?U)(?<![^\x20\x09-\x0D])\p{L}+[.,;:?]?(?![^\x20\x09-\x0D])").alias("n_plain"),
        F.size("_l").cast("long").alias("n_lines"),
    )


def rules() -> dict[str, Column]:
    """Name -> vote. A rule for one kind of fault abstains where it finds none."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    bad, good = F.lit(0), F.lit(1)
    per_word = lambda c: F.col(c) / n
    return {
        "plain": F.when(per_word("n_plain") >= 0.85, good).when(per_word("n_plain") < 0.65, bad),
        "symbols": F.when(per_word("n_symbols") > 0.1, bad).when(per_word("n_symbols") < 0.02, good),
        "case": F.when(F.col("n_upper") > 0.35 * F.col("word_chars"), bad),
        "marks": F.when(per_word("n_marks") > 0.2, bad),
        "windows": F.when(per_word("n_repeat_words") > 0.3, bad).when(per_word("n_repeat_words") < 0.1, good),
        "lines": F.when(F.col("n_dup_lines") > 0.3 * F.col("n_lines"), bad),
        "word_size": F.when((F.col("word_chars") > 15 * n) | (F.col("word_chars") < 2 * n), bad),
        "length": F.when(F.col("n_words") < LEAST_WORDS, bad),
    }


def votes() -> Column:
    """The votes as an array of 1, 0 and -1 (abstains)."""
    return F.array(*[F.coalesce(v, F.lit(-1)) for v in rules().values()])


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(votes, n) -> (votes, posterior), by expectation-maximisation.

    Accuracies stay within 0.55 and 0.995, and the share of good documents within
    0.05 and 0.95, so that more good votes never lower a posterior.
    """
    n_rules = len(rules())
    each = [F.lit(j) for j in range(n_rules)]
    clip = lambda x, lo, hi: F.least(F.greatest(x, F.lit(lo)), F.lit(hi))

    def posterior(v: Column, good: Column, acc: Column) -> Column:
        odds = F.aggregate(
            F.zip_with(v, acc, lambda x, a: F.when(x == 1, F.log(a / (1 - a))).when(x == 0, F.log((1 - a) / a)).otherwise(F.lit(0.0))),
            F.log(good / (1 - good)),
            lambda s, x: s + x,
        )
        return 1 / (1 + F.exp(-odds))

    p = F.col("p")

    def improve(state: Column, _: Column) -> Column:
        scored = F.transform(p, lambda x: F.struct(x["votes"].alias("v"), x["n"].cast("double").alias("n"), posterior(x["votes"], state["good"], state["acc"]).alias("g")))
        zero = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "g")], F.array(*[F.lit(0.0) for _ in each]).alias("right"), F.array(*[F.lit(0.0) for _ in each]).alias("cast"))
        add = lambda a, x: F.struct(
            (a["n"] + x["n"]).alias("n"),
            (a["g"] + x["n"] * x["g"]).alias("g"),
            F.zip_with(a["right"], x["v"], lambda r, v: r + x["n"] * F.when(v == 1, x["g"]).when(v == 0, 1 - x["g"]).otherwise(F.lit(0.0))).alias("right"),
            F.zip_with(a["cast"], x["v"], lambda r, v: r + x["n"] * F.when(v >= 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("cast"),
        )
        finish = lambda a: F.struct(
            clip(a["g"] / a["n"], 0.05, 0.95).alias("good"),
            F.zip_with(a["right"], a["cast"], lambda r, c: clip((r + 8.0) / (c + 10.0), 0.55, 0.995)).alias("acc"),
        )
        return F.aggregate(scored, zero, add, finish)

    row = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("p")).filter(F.size("p") > 0)
    start = F.struct(F.lit(0.8).alias("good"), F.array(*[F.lit(0.8) for _ in each]).alias("acc"))
    row = row.withColumn("m", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, improve))
    row = row.select("m", F.explode("p").alias("x"))
    return row.select(F.col("x.votes").alias("votes"), posterior(F.col("x.votes"), F.col("m.good"), F.col("m.acc")).alias("posterior"), F.col("m.acc").alias("accuracies"))


def judged(figs: DataFrame) -> DataFrame:
    """Figures -> with votes, posterior, base_failed and kept."""
    v = figs.withColumn("votes", votes())
    # 3^R patterns at most: a bounded broadcast.
    post = F.broadcast(estimate(v.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))).select("votes", "posterior"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return v.join(post, "votes").withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= THRESHOLD))


def score_quality(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, figures, votes, posterior, base_failed, kept."""
    return judged(checkpoint(figures(docs, ["doc_id"])))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the model keeps, with their own columns.

    Rows and figures are written once to the shared folder: the model reads the
    figures, then the verdict filters the rows where they lie. Neither texts nor
    verdicts are shuffled or joined by an id.
    """
    path = scratch(docs.sparkSession, "figures")
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    figures(packed, ["_row"]).write.parquet(path)
    return judged(docs.sparkSession.read.parquet(path)).filter("kept").select("_row.*")
