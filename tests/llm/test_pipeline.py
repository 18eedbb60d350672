import zlib

import corpus_pipeline as P
from runloom.llm.common import table


def test_stages_follow_each_other(spark, sample, docs, no_docs):
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "near_dedup", "pii", "mixing", "packing"]
    for n, f in P.STAGES[:-1]:
        assert f(spark, docs, sample).columns == docs.columns
        assert f(spark, no_docs, sample).count() == 0


def test_run(spark, sample):
    out = P.run(spark, sample).collect()
    assert out and all(zlib.crc32(r.ids) == r.ids_crc32 for r in out)
    kept = P.near_dedup(spark, P.quality(spark, table(spark, sample, "documents"), sample), sample)
    assert {r.doc_id for r in out} <= {r.doc_id for r in kept.select("doc_id").collect()}
