import tracemalloc

import pyarrow as pa
import pytest

from runloom.functions import hashing, lexemes
from runloom.operators import chunking


class Rows:
    """Stands for a DataFrame: gives the function that tasks run."""

    def __init__(self, spark, schema):
        self.sparkSession, self.schema = spark, schema

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return run


TEXT = " ".join(f"word{i}" for i in range(100))


def keyed(n):
    return pa.RecordBatch.from_pydict({"k": [str(i) for i in range(n)], "t": [TEXT] * n})


def documents(n):
    page = "\n\n".join(f"# Part {i}\n\n{TEXT}" for i in range(3))
    row = {"page_id": "p", "title": "t", "url": "u", "space_key": "s", "version": 1, "labels": ["x"], "markdown": page, "content_hash": "h"}
    return pa.RecordBatch.from_pylist([row] * n)


@pytest.mark.parametrize("name", ["postings", "embed", "chunks"])
def test_memory_does_not_grow_with_the_batch(spark, name):
    d = spark.createDataFrame([], "k string, t string")
    rows = Rows(spark, d.schema)
    run, make, n = {
        "postings": (lambda: lexemes.counted(rows, "k", "t"), keyed, 1000),
        "embed": (lambda: hashing.embed(rows, "k", "t"), keyed, 2000),
        "chunks": (lambda: chunking.chunk_documents(rows), documents, 100),
    }[name]
    peaks, out = [], []
    for times in (1, 4):
        batch, f, made = make(n * times), run(), 0
        tracemalloc.start()
        for b in f(iter([batch])):
            made += len(b)
            del b
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        out.append(made)
    assert out[1] == 4 * out[0] > 0
    assert peaks[1] < 1.4 * peaks[0]
