import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.operators import blockmax, lexical


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """6,000 texts: words of all, many and few texts, of very different lengths."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(6000):
        n = int(rng.lognormal(3.2, 0.9)) + 3
        w = [f"common{x}" for x in rng.zipf(1.6, n) % 40] + [f"rare{rng.integers(0, 900)}" for _ in range(rng.integers(0, 4))]
        rows.append((f"c{i}", "everywhere " + " ".join(w)))
    path = str(tmp_path_factory.mktemp("corpus") / "texts")
    spark.createDataFrame(rows, "chunk_id string, embed_text string").write.parquet(path)
    c = spark.read.parquet(path)
    return lexical.postings(c, with_lengths=True), lexical.lengths(c)


def queries(spark):
    texts = [f"everywhere common1 common{i % 9} rare{i} rare{i + 300}" for i in range(40)] + ["everywhere", "common2 common3", "unknown", "", "rare7", "everywhere everywhere common1"]
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def rows(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())


def test_equals_bm25(spark, corpus, tmp_path):
    posts, lens = corpus
    index = blockmax.blocks(posts, lens, 64).write(str(tmp_path / "blocks"))
    q = queries(spark)
    for k in (1, 10, 30):
        assert rows(blockmax.topk(q, index, k)) == rows(lexical.bm25_topk(q, posts, lens, k))
    sizes = [r.n for r in index.postings.groupBy("block").agg(F.count_distinct("chunk_id").alias("n")).collect()]
    assert max(sizes) <= 2.5 * 64


def test_few_blocks_of_frequent_terms_are_read(spark, corpus, tmp_path):
    posts, lens = corpus
    index = blockmax.blocks(posts, lens, 16).write(str(tmp_path / "blocks"))
    q = spark.createDataFrame([(i, f"everywhere common1 rare{i} rare{i + 300}") for i in range(0, 300, 20)], "query_id long, text string")
    p = blockmax.passes(q, index, 5)
    r = blockmax.reading(p, index).first()
    assert r.asked > 5000 and r.read < 0.2 * r.asked
    # The stored postings are met by term and block, never by term alone.
    plan = blockmax.topk(q, index, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "term" in plan and "block" in plan


def test_empty_tables(spark):
    posts = spark.createDataFrame([], "chunk_id string, term string, tf long, dl long")
    lens = spark.createDataFrame([], "chunk_id string, dl long")
    assert blockmax.topk(queries(spark), blockmax.blocks(posts, lens)).count() == 0


def test_no_row_is_moved_for_a_document_and_a_query(spark, corpus, tmp_path):
    posts, lens = corpus
    index = blockmax.blocks(posts, lens, 64).write(str(tmp_path / "blocks"))
    # One row a term and block, stored once; a document's rows are in one file.
    assert sorted(f.name for f in (tmp_path / "blocks").iterdir()) == ["lists", "stats"]
    stored = spark.read.parquet(str(tmp_path / "blocks" / "lists"))
    assert stored.count() == index.postings.select("term", "block").distinct().count()
    files = stored.select(F.input_file_name().alias("f"), F.explode("docs.chunk_id").alias("c")).groupBy("c").agg(F.count_distinct("f").alias("n"))
    assert files.agg(F.max("n")).first()[0] == 1
    plan = blockmax.topk(queries(spark), index, 5)._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert moved and not any("chunk_id" in x for x in moved)
