"""What lookups and filtered searches read of the stored files."""

import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from runloom.operators import filters
from runloom.plans.ingest import ingest
from runloom.plans.store import Store

DOC = "page_id string, title string, url string, space_key string, version int, labels array<string>, markdown string, content_hash string"
SPACES, PAGES = "ABCDEFGH", 480


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """One bucket of many small row groups."""
    r = random.Random(3)
    text = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(150))
    rows = [(f"p{i:03d}", f"Page {i}", "", SPACES[i % 8], 1, [], f"## One\n\n{text()}\n\n## Two\n\n{text()}", f"h{i}") for i in range(PAGES)]
    s = Store(spark, str(tmp_path_factory.mktemp("groups") / "s"), buckets=1)
    spark.conf.set("parquet.block.size", str(96 << 10))
    try:
        ingest(s, spark.createDataFrame(rows, DOC))
    finally:
        spark.conf.unset("parquet.block.size")
    return s


def rows_read(spark, df, files):
    """The rows that scans of these files hand on, i.e. those of row groups that were not skipped; and the result."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        qe = df._jdf.queryExecution()
        n = len(qe.executedPlan().executeCollect())
        leaves = qe.executedPlan().collectLeaves()
        scans = [leaves.apply(i) for i in range(leaves.size())]
        read = [s.metrics().get("numOutputRows").get().value() for s in scans if f"/data/{files}/" in s.verboseString(1000)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    return sum(read), n


def test_row_groups_are_skipped(spark, store):
    files = list(Path(store.folder, "data", "chunks").rglob("*.parquet"))
    sizes = [pq.ParquetFile(f).metadata.row_group(i).num_rows for f in files for i in range(pq.ParquetFile(f).num_row_groups)]
    total, two = store.table("chunks").count(), 2 * max(sizes)
    assert len(files) == 1 and len(sizes) >= 8 and total == sum(sizes) == 2 * PAGES
    whole, n = rows_read(spark, store.table("chunks"), "chunks")
    assert whole == n == total
    # A section, a page: two row groups at most.
    section, n = rows_read(spark, store.section("p123", 1), "chunks")
    assert n == 1 and 0 < section <= two
    page, n = rows_read(spark, store.page("p123"), "chunks")
    assert n == 2 and 0 < page <= two
    # A space has an eighth of the pages; the filter of a search reads these and the ends of their row groups.
    space, n = rows_read(spark, filters.apply(store.table("chunks"), {"space_key": "C"}), "chunks")
    assert n == total / 8 and 0 < space <= total / 8 + two
    assert {r.page_id for r in store.section("p123", 1).collect()} == {"p123"} and store.page("none").count() == 0
