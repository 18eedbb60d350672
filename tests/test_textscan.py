import random
import time
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from runloom.functions import lexemes
from runloom.operators import fusion, lexical, textscan
from runloom.plans import catalogue

ODD = [
    None, "", " \t\n", "...", "a", "A", "I am", "the THE The", "HTTPServer httpServer http_server", "a.b-c/d:e_f", "PSQLException:FATAL_42", "ABC ABC1 A1B 1A aB Ab x9Y", "--edge.. .Edge: _x_", "é naïve Ünïcode ſtraße K",
    "org.postgresql.util.PSQLException", "x" * 200, "word\x00word   word word", "iPhone12ProMax v1.2.3-beta", "fooBar FooBar foo.Bar foo-bar", "🙂ok🙂",
]


def plain(text):
    return Counter(t for w in lexemes._FOUND.findall(text or "") for t in lexemes.plain_word_terms(w))


def test_looker_counts_as_one_word_after_the_other_does():
    rng = random.Random(5)
    texts = ODD + [rng.choice([" ", "\n", ", "]).join(rng.choice(ODD[3:]) for _ in range(rng.randint(1, 6))) for _ in range(300)]
    every = sorted({t for x in texts for t in plain(x)})
    for wanted in (every, every[::3], ["nowhere"], []):
        for given in (pa.array(texts, pa.string()), pa.array(["first", *texts], pa.string()).slice(1), pa.array([], pa.string())):
            row, term, tf, dl = lexemes.looker(wanted)(given)
            sums = [plain(x) for x in given.to_pylist()]
            assert [(r, wanted[t], n) for r, t, n in zip(row.tolist(), term.tolist(), tf.tolist())] == [(i, t, c[t]) for i, c in enumerate(sums) for t in wanted if c[t]]
            assert dl.tolist() == [sum(c.values()) for c in sums]


def corpus(spark, rng):
    words = ["pool", "the", "Database", "fooBar", "foo.bar", "lag", "x9", "retry", "kafka", "HTTPServer", "zz"]
    texts = ODD + ["pool lag"] * 40 + [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(200)]
    rng.shuffle(texts)
    return spark.createDataFrame([(f"{rng.getrandbits(64):016x}", i, x) for i, x in enumerate(texts)], "chunk_id string, n int, embed_text string").repartition(3)


@pytest.mark.parametrize("scores,parts,block", [(1 << 18, 1 << 20, 4096), (7, 5, 3)])
def test_bm25_of_read_texts_equals_that_of_postings(spark, monkeypatch, scores, parts, block):
    for name, value in (("SCORES", scores), ("PARTS", parts), ("QUERY_BLOCK", block)):
        monkeypatch.setattr(textscan, name, value)
    c = corpus(spark, random.Random(9)).persist()
    asked = [(1, "pool lag"), (2, "foo bar"), (3, None), (4, "the"), (5, "unknownterm"), (6, "HTTPServer kafka retry x9 zz pool lag"), (7, "Database fooBar"), (7, "Database"), (8, "word psqlexception")]
    q = spark.createDataFrame(asked, "query_id int, text string")
    for k in (1, 5, 1000):
        want = lexical.bm25_topk(q, lexical.postings(c, with_lengths=True), lexical.lengths(c), k).withColumn("score", F.round("score", 9))
        got = textscan.bm25_texts(q, c, k=k, keep=("n",)).withColumn("score", F.round("score", 9))
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
        assert got.join(c, ["chunk_id", "n"], "left_anti").count() == 0
    none = textscan.bm25_texts(q.filter("query_id = 3"), c, k=5, keep=("n",))
    assert none.count() == 0 and none.columns == got.columns
    assert textscan.bm25_texts(q, c.limit(0), k=5).count() == 0
    c.unpersist()


def moved(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("told", [True, False])
def test_sections_of_few_hits_leave_chunks_where_they_are(spark, told):
    c = spark.createDataFrame([(f"{p}{s}{i}", p, s, i) for p in "abc" for s in range(3) for i in range(3)], "chunk_id string, page_id string, section_index int, chunk_index int")
    hits = [(1, "b10", 0, "b", 1), (1, "a02", 1, "a", 0), (1, "b12", 2, "b", 1), (2, "c20", 0, "c", 2)]
    h = spark.createDataFrame(hits, "query_id int, chunk_id string, rank int, page_id string, section_index int")
    h = h if told else h.drop("page_id", "section_index")
    want = [(1, x) for x in ("b10", "b11", "b12", "a00", "a01", "a02")] + [(2, x) for x in ("c20", "c21", "c22")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few in (True, False):
            found = fusion.expand(h, c, few)
            assert [(r.query_id, r.chunk_id) for r in found.orderBy("query_id", "pos").collect()] == want
            assert ("SortMergeJoin" in moved(found)) != few
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def written(spark, monkeypatch, name):
    """Rows that a query of the catalogue writes to read them again, and its plan."""
    rows, real = [], catalogue.settled
    monkeypatch.setattr(catalogue, "settled", lambda df, *a: rows.append((out := real(df, *a)).count()) or out)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
        found.collect()
        return sum(rows), moved(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_section_expand_writes_and_moves_hits_alone(spark, monkeypatch):
    rows, plan = written(spark, monkeypatch, "section_expand")
    assert 0 < rows <= 6 * spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").count()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_context_render_writes_and_moves_hits_alone(spark, monkeypatch):
    rows, plan = written(spark, monkeypatch, "context_render")
    assert 0 < rows <= 6 * spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").count()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_looker_on_words_of_every_width_and_edge():
    rng = random.Random(11)
    words = [s + w + e for n in range(1, 20) for w in ("a" * n, "A" * n, "A" + "a" * (n - 1), "7" * n, "a" * n + "B") for s in ("", "-", "..", ":::") for e in ("", ".", "//", "___")]
    texts = words + ["\n".join(rng.choices(words, k=30)) for _ in range(50)] + ["".join(rng.choices("aZ9.-é \n\x00", k=200)) for _ in range(200)] + ["---", "-", "a" * 16, "a" * 17, None]
    every = sorted({t for x in texts for t in plain(x)})
    # The same first and last eight bytes, other words between; stop words are never told.
    for wanted in (every, every[1::2], ["the", "aaaaaaaaab", "aaaaaaaaaa"]):
        row, term, tf, dl = lexemes.looker(wanted)(pa.array(texts, pa.string()))
        sums = [plain(x) for x in texts]
        order = {t: i for i, t in enumerate(wanted)}
        assert list(zip(row.tolist(), term.tolist(), tf.tolist())) == [(i, order[t], c[t]) for i, c in enumerate(sums) for t in wanted if c[t]]
        assert dl.tolist() == [sum(c.values()) for c in sums]


def test_looking_takes_less_time_than_splitting_words_and_telling_them_apart():
    rng = random.Random(3)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 11))) for _ in range(40_000)]
    texts = pa.array([" ".join(rng.choices(words, k=50)).capitalize() + "." for _ in range(800)])
    look = lexemes.looker(rng.sample(sorted(set(words)), 3000))

    def least(f):
        took = []
        for _ in range(9):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: look(texts)) < least(lambda: pc.split_pattern_regex(texts, r"[^A-Za-z0-9_./:\-]+").flatten().dictionary_encode())


@pytest.mark.parametrize("looked,scores", [(1 << 18, 1 << 18), (9, 7)])
def test_bm25_of_lines_equals_that_of_one_text_a_line(spark, monkeypatch, looked, scores):
    monkeypatch.setattr(textscan, "LOOKED", looked)
    monkeypatch.setattr(textscan, "SCORES", scores)
    rng = random.Random(4)
    texts = ["", "\n", "\n\n pool lag\n", None, "pool lag\r\nthe", "é pool\nlag é\n"] + ["\n".join(rng.choice(["", "pool lag", "the", "fooBar zz", "kafka retry pool", "lag lag"]) for _ in range(rng.randint(1, 9))) for _ in range(80)]
    d = spark.createDataFrame(list(enumerate(texts)), "n int, text string").repartition(3)
    pages = d.select(F.col("n").cast("string").alias("page_id"), F.lit("t").alias("title"), F.lit("u").alias("url"), F.coalesce("text", F.lit("")).alias("markdown"))
    c = catalogue.lines_of(pages).persist()
    q = spark.createDataFrame([(1, "pool lag"), (2, "foo bar"), (3, None), (4, "kafka pool"), (5, "zz")], "query_id int, text string")
    for k in (1, 6, 1000):
        want = textscan.bm25_texts(q, c, "body_text", k, keep=("page_id", "section_index"))
        got = textscan.bm25_lines(q, pages, catalogue.line_chunk, "chunk_id string, page_id string, section_index int", k=k)
        assert got.columns == want.columns
        rows = [sorted((*r[:4], round(r.score, 9), r["rank"]) for r in x.collect()) for x in (got, want)]
        assert rows[0] == rows[1] and rows[0]
    c.unpersist()


@pytest.mark.parametrize("name", ["section_expand", "context_render"])
def test_lines_are_made_of_pages_with_hits_alone(spark, monkeypatch, name):
    plans, real = [], catalogue.settled
    monkeypatch.setattr(catalogue, "settled", lambda df, *a: plans.append(moved(df)) or real(df, *a))
    plan = moved(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert len(plans) == 1 and "Generate" not in plans[0]
    # Plans are written from the top down.
    assert "LeftSemi" in plan and plan.index("Generate") < plan.index("LeftSemi")
