import re

import pytest
from pyspark.sql import functions as F

from runloom.functions import hashing, lexemes, signals, text as T


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("word,want", [
    ("org.postgresql.util.PSQLException", ["org.postgresql.util.psqlexception", "org", "postgresql", "util", "psqlexception", "org.postgresql.util.psql", "psql", "exception"]),
    ("NullPointerException", ["nullpointerexception", "null", "pointer", "exception"]),
    ("ERR_POOL_EXHAUSTED", ["err_pool_exhausted", "err", "pool", "exhausted"]),
    ("5 is a gc", ["gc"]), ("", []), (None, []), ("./:", []), ("café 503", ["caf", "503"]),
])
def test_terms(spark, word, want):
    assert one(spark, word, lexemes.terms) == want


def plain_terms(text):
    out = []
    for raw in re.findall(r"[A-Za-z0-9_./:\-]+", text):
        seen = []
        parts = re.sub(r"(?<=[A-Z])(?=[A-Z][a-z])", " ", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", raw)).split()
        for form in [raw, *parts]:
            low = form.lower().strip("./:-_")
            seen += [t for t in [low, *re.split(r"[./:_\-]+", low)] if len(t) > 1 and t not in lexemes.STOP_WORDS]
        out += dict.fromkeys(seen)
    return out


def test_terms_against_a_plain_model(spark):
    import random

    r = random.Random(2)
    texts = ["".join(r.choice("abXYZ09_./:- é") for _ in range(r.randint(0, 40))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", lexemes.terms(F.col("x")).alias("t")).collect()
    assert all(r.t == plain_terms(texts[r.i]) for r in rows)


@pytest.mark.parametrize("title,kind", [
    ("Rollback", "rollback"), ("Who to page", "escalation"), ("Health check", "verification"), ("Remediation Steps", "remediation"), ("Checks", "diagnosis"),
    ("Symptoms", "symptoms"), ("SLA", "impact"), ("Before you begin", "prerequisites"), ("See also", "references"), ("Overview", "overview"), ("Bananas", "other"), ("", "other"),
])
def test_kinds(spark, title, kind):
    from runloom.operators.chunking import kind_of

    assert one(spark, title, T.section_kind) == kind == kind_of(title)


def test_inherited_kind(spark):
    d = spark.createDataFrame([("Bananas", ["Diagnosis", "Bananas"]), ("Bananas", ["Bananas"]), ("Steps", ["Diagnosis", "Steps"])], "t string, p array<string>")
    assert [r.k for r in d.select(T.inherited_kind(F.col("t"), F.col("p")).alias("k")).collect()] == ["diagnosis", "other", "remediation"]


@pytest.mark.parametrize("t", ["", "a", "one two three", "x" * 401, "word " * 300, "tab\tand\nline   space"])
def test_counts_and_preview(spark, t):
    from runloom.operators.chunking import estimate, fallback

    assert one(spark, t, T.token_estimate) == estimate(t) and one(spark, t, T.token_fallback) == fallback(t)
    flat = " ".join(t.split())
    assert one(spark, t, T.preview) == (flat[:400] + "…" if len(flat) > 400 else flat)


def test_signals(spark):
    t = "FATAL java.lang.NullPointerException in my-svc-7d9f8b-abcde ECONNREFUSED status 503 and 999 at /var/log/app.log a.b.c 1.2.3 ERROR"
    s = one(spark, t, signals.signals)
    assert s.exceptions == ["java.lang.NullPointerException"] and s.http_codes == ["503"] and s.error_codes == ["ECONNREFUSED"]
    assert s.qualified_names == ["java.lang.NullPointerException", "a.b.c"] and s.resources == ["my-svc-7d9f8b-abcde"] and s.paths == ["/var/log/app.log"]


def test_variants(spark):
    v = lambda t: one(spark, t, signals.variants)
    assert v("") == [] and v(None) == [] and v("  plain   prose ") == ["plain prose"]
    assert v("got PSQLException here") == ["got PSQLException here", "PSQLException"]
    long = "First part. Second part. " + "more words " * 80
    assert v(long)[-1] == "First part Second part" and len(v(long)[0]) == 600


def test_each_pattern_is_looked_for_once(spark, tmp_path):
    texts = ["", None, "got PSQLException here", "First part. Second part. third. " + "more words " * 80, "status 503 a.b.c my-svc-7d9f8b /var/log/x.log ABC_DEF"]
    path = str(tmp_path / "texts")
    spark.createDataFrame(list(enumerate(texts)), "query_id long, text string").write.parquet(path)
    q = spark.read.parquet(path)
    found = signals.query_variants(q)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    for pattern in ("Exception|Error|Failure", "[1-5]", "[A-Z0-9]{2,}", r"(?:\.\w+){2,}", "(?:-[a-z0-9]+){2,}", "(/(?:"):
        assert plan.count(pattern) == 1
    want = q.select("query_id", F.posexplode(signals.variants(F.col("text"))).alias("ord", "variant"))
    assert sorted(found.collect()) == sorted(want.collect())


def test_hashing_forms_agree(spark):
    d = spark.createDataFrame([("a", "Kafka lag kafka lag"), ("b", ""), ("c", None), ("d", "one")], "k string, t string")
    bulk = {r.k: {i: n for i, n in enumerate(r.counts) if n} for r in hashing.embed(d, "k", "t").collect()}
    plain = {}
    for r in hashing.counts(d, "k", "t").collect():
        plain.setdefault(r.k, {})[r.idx] = r.n
    assert {k: v for k, v in bulk.items() if v} == plain and bulk["b"] == {}
    u = hashing.embed(d, "k", "t").select(hashing.unit(F.col("counts")).alias("u")).collect()
    assert [round(sum(x * x for x in r.u), 4) for r in u] == [1.0, 0.0, 0.0, 1.0]
