import duckdb
import pytest
from runloom.llm.oracles import ORACLES
from runloom.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_its_oracle(spark, sample, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sample}/{t}.parquet'")
    want = c.sql(ORACLES[name])
    df = QUERIES[name](spark, sample)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    rows = sorted(tuple(r[n] for n in names) for r in df.collect())
    for a, b in zip(rows, sorted(tuple(r[i] for i in at) for r in want.fetchall()), strict=True):
        assert a == pytest.approx(b)


def test_columns_of_the_contracts(spark, sample):
    want = {
        "op1_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op2_records": "doc_id start n_tokens ids_crc32",
        "op3_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        "op4_ann": "query_id rank vec_id score",
        "op5_simhash": "doc_id fingerprint component_id",
        "op6_html": "page_id url text n_chars",
        "op7_langid": "doc_id held_out lang_pred score",
        "op8_shard": "doc_id size text_crc32 law shard slot grown_shard",
        "op9_mix": "doc_id size source_size target taken",
        "op10_pack": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        "op11_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
        "op12_best_fit": "doc_id piece start length ids_crc32 sequence_id offset",
        "op13_upsert": "first_id n_rows cents rows_crc ids_sha256 columns path rewritten",
    }
    assert set(want) == set(QUERIES)
    for name, columns in want.items():
        df = QUERIES[name](spark, sample)
        assert df.columns[: len(columns.split())] == columns.split()
        longs = {n for n, t in df.dtypes if t == "bigint"}
        assert {c for c in columns.split() if c.startswith("n_") or c in ("start", "length", "slot", "size", "taken", "ids_crc32", "text_crc32")} <= longs
