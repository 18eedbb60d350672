import math

import duckdb
import pytest

import __spark_entry__ as entry
from runloom import config as C
from runloom.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_precedence_and_profiles():
    m = {"chunking": {"max_tokens": 300, "active": "small", "profiles": {"small": {"min_tokens": 10}, "big": {"min_tokens": 50}}}, "source": {"base_url": "https://example.test/", "token": "t"}}
    c = C.load(m, env={"RUNLOOM_CHUNKING_MAX_TOKENS": "200", "RUNLOOM_SOURCE_SPACES": "A, B", "RUNLOOM_RETRIEVAL_LEXICAL_FILTERS": "no"})
    assert (c.chunking.max_tokens, c.chunking.min_tokens, c.source.base_url, c.source.spaces, c.retrieval.lexical_filters) == (200, 10, "https://example.test", ["A", "B"], False)
    assert C.load(m, profile="big", env={}).chunking.min_tokens == 50 and c.summary()["source"]["token"] == "***"
    for bad in ({"chunking": {"min_tokens": 600}}, {"embedding": {"dimensions": 5}}, {"chunking": {"nope": 1}}, {"chunking": {"active": "x"}}):
        with pytest.raises(ValueError):
            C.load(bad, env={})


def test_dotenv(tmp_path):
    f = tmp_path / ".env"
    f.write_text("# c\nexport A='1'\nB=two\n\nnoise")
    assert C.read_dotenv(str(f)) == {"A": "1", "B": "two"}


def test_settings_from_files(tmp_path, monkeypatch):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "runloom.yaml").write_text("folder: store\nchunking:\n  max_tokens: 300\n  active: small\n  profiles:\n    small: {min_tokens: 10}\n    big: {min_tokens: 50}\n")
    (tmp_path / "a" / ".env").write_text("RUNLOOM_CHUNKING_MAX_TOKENS=250\nRUNLOOM_SOURCE_TOKEN=t\n")
    c = C.load_files(env={}, folder=str(tmp_path / "a" / "b"))
    assert (c.folder, c.chunking.max_tokens, c.chunking.min_tokens, c.source.token) == ("store", 250, 10, "t")
    c = C.load_files(env={"RUNLOOM_CHUNKING_MAX_TOKENS": "200", "RUNLOOM_PROFILE": "big"}, folder=str(tmp_path / "a"))
    assert (c.chunking.max_tokens, c.chunking.min_tokens) == (200, 50)
    (tmp_path / "c.json").write_text('{"chunking": {"max_tokens": 111}}')
    assert C.load_files(str(tmp_path / "c.json"), env={}, folder=str(tmp_path)).chunking.max_tokens == 111
    for text in ("- a\n", "nope: {}\n"):
        (tmp_path / "bad.yaml").write_text(text)
        with pytest.raises(ValueError):
            C.load_files(str(tmp_path / "bad.yaml"), env={}, folder=str(tmp_path))
    with pytest.raises(OSError):
        C.load_files(str(tmp_path / "none.yaml"), env={}, folder=str(tmp_path))


def value(v):
    return round(v, 8) if isinstance(v, float) and math.isfinite(v) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "customer part events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_its_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    rows = sorted((tuple(value(r[c]) for c in names) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in names]
    assert rows == sorted((tuple(value(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_approximate_search_finds_the_nearest(spark):
    exact = {(r.query_id, r.chunk_id) for r in QUERIES["dense_topk"](spark, SF).filter("rank < 5").collect()}
    got = {(r.query_id, r.chunk_id) for r in QUERIES["dense_ann_ivf"](spark, SF).collect()}
    assert len(exact & got) >= 0.9 * len(exact)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
