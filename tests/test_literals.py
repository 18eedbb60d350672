import pytest
from literals import MARKUP, STRUCTURE

from runloom.operators import chunking, normalize


def test_markup(spark):
    pages = spark.createDataFrame([(n, s) for n, s, _ in MARKUP], "name string, storage_html string")
    assert {r.name: r.markdown for r in normalize.normalize_pages(pages).collect()} == {n: m for n, _, m in MARKUP}


@pytest.mark.parametrize("case", STRUCTURE, ids=[s[0] for s in STRUCTURE])
def test_structure(spark, case):
    name, text, most, least, overlap, want = case
    page = spark.createDataFrame([(name, "Page", "u", "S", 1, ["l"], text, "h")], "page_id string, title string, url string, space_key string, version int, labels array<string>, markdown string, content_hash string")
    made = chunking.chunk_documents(page, most, least, overlap).collect()
    assert [(r.section_index, r.chunk_index, " > ".join(r.section_path), r.section_kind, r.body_text) for r in made] == [tuple(w) for w in want]
