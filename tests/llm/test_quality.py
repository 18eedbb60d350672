import re

from pyspark.sql import functions as F
from runloom.llm.common import table
from runloom.llm.quality import estimate, keep_good, score_quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {t for t in three if three.count(t) > 1} if len(three) < 3000 else {t for t in three}
    covered = {i + k for i, t in enumerate(three) if t in twice for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_figures_match_brute_force(spark, docs, sample):
    for d in (docs.filter("doc_id is null or doc_id <> 9"), table(spark, sample, "documents")):
        text = {(r.doc_id): r.text for r in d.collect()}
        for r in score_quality(d).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text[r.doc_id])
            failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
            assert r.base_failed == failed and not (failed and r.kept)


def test_long_text_of_repeats(docs):
    r = score_quality(docs.filter("doc_id = 9")).first()
    assert r.n_words == 20_000 and r.n_repeat_words == 20_000 and r.base_failed


def test_agrees_with_labels(spark, sample):
    q = score_quality(table(spark, sample, "documents"))
    labels = spark.read.parquet(f"{sample}/labels.parquet")
    rows = q.filter("not base_failed").join(labels, "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.95 * len(rows)


def test_estimation_matches_a_plain_model(spark):
    import math

    votes = [([1, 1, -1, -1, 1, -1, -1, -1], 50), ([0, 0, -1, -1, 1, -1, -1, -1], 9), ([1, -1, 0, 0, -1, -1, -1, -1], 6)]
    got = {tuple(r.votes): r.posterior for r in estimate(spark.createDataFrame(votes, "votes array<int>, n long"), rounds=12).collect()}
    good, acc = 0.8, [0.8] * 8
    def post(v):
        s = math.log(good / (1 - good)) + sum(math.log(a / (1 - a)) * (1 if x == 1 else -1) for x, a in zip(v, acc) if x >= 0)
        return 1 / (1 + math.exp(-s))
    for _ in range(12):
        g = [post(v) for v, _ in votes]
        n = [k for _, k in votes]
        new = []
        for j in range(8):
            cast = sum(k for (v, k) in votes if v[j] >= 0)
            right = sum(k * (p if v[j] == 1 else 1 - p) for (v, k), p in zip(votes, g) if v[j] >= 0)
            new.append(min(max((right + 8) / (cast + 10), 0.55), 0.995))
        good, acc = min(max(sum(a * b for a, b in zip(n, g)) / sum(n), 0.05), 0.95), new
    for v, _ in votes:
        assert abs(got[tuple(v)] - post(v)) < 1e-9


def test_keep_good_keeps_columns_and_empty_tables(docs, no_docs):
    assert keep_good(docs).columns == docs.columns
    assert score_quality(no_docs).count() == 0 and keep_good(no_docs).count() == 0
    assert score_quality(docs).count() == docs.count()


def test_plan_has_no_python(docs):
    plan = score_quality(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert F is not None
