import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.operators import dense, ivf


def clustered(n, width, clusters, seed):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((clusters, width))
    return c[rng.integers(0, clusters, n)] + 0.35 * rng.standard_normal((n, width))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    import pyarrow as pa
    import pyarrow.parquet as pq

    x = clustered(60_000, 24, 300, 3).astype(np.float32)
    path = tmp_path_factory.mktemp("ivf")
    for i in range(4):
        part = x[i::4]
        pq.write_table(pa.table({"chunk_id": np.arange(i, 60_000, 4), "embedding": pa.array(list(part), pa.list_(pa.float32()))}), path / f"{i}.parquet")
    return spark.read.parquet(str(path))


def test_recall_on_a_tenth_of_the_rows(spark, table, tmp_path):
    index = ivf.train(table)
    path = str(tmp_path / "filed")
    ivf.filed(table, index).repartition(4).sortWithinPartitions("cell").write.parquet(path)
    ivf.save(spark, index, str(tmp_path / "index"))
    index = ivf.load(spark, str(tmp_path / "index"))
    rows = spark.read.parquet(path)
    assert rows.count() == 60_000
    sizes = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}
    asked = table.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    read = [sum(sizes.get(int(c), 0) for c in cells) for _, _, part in ivf.visited(asked, index) for cells in part]
    assert len(read) == 3000 and np.mean(read) < 6000
    got = {(r.query_id, r.chunk_id): r.score for r in ivf.search(asked, rows, index, 10).collect()}
    want = {(r.query_id, r.chunk_id): r.score for r in dense.dense_topk(asked, table, 10).collect()}
    assert len(got) == 30_000 and len(got.keys() & want.keys()) >= 0.9 * len(want)
    for pair in list(got.keys() & want.keys())[:500]:
        assert got[pair] == pytest.approx(want[pair], abs=1e-9)
    # One query's cells reach the scan.
    plan = ivf.search(asked.limit(1), rows, index, 10)._jdf.queryExecution().executedPlan().toString()
    assert "In(cell" in plan or "EqualTo(cell" in plan


def test_all_cells_are_exact_and_odd_rows(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(200)] + [(300, None), (301, [1.0, None, 2.0]), (302, [float("nan"), 1.0, 1.0]), (303, [1.0]), (304, [0.0, 0.0, 0.0])]
    d = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    index = ivf.train(d, cells=5, probes=5)
    f = ivf.filed(d, index)
    assert f.count() == 201 and {"cell", "code", "scale"} <= set(f.columns)
    asked = d.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    cut = lambda df: sorted((r.query_id, r["rank"], r.chunk_id) for r in df.collect())
    # Rows of one direction are more than a query's candidates, so compare scores.
    score = lambda df: sorted((r.query_id, r["rank"], round(r.score, 9)) for r in df.collect())
    assert score(ivf.search(asked, f, index, 8)) == score(dense.dense_topk(asked, d, 8)) and len(cut(ivf.search(asked, f, index, 8)))
    none = spark.createDataFrame([], "chunk_id long, embedding array<double>")
    assert ivf.train(none) is None and ivf.search(none.withColumnRenamed("chunk_id", "query_id"), f, index).count() == 0
