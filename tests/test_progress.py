import io
import json
import logging

import pytest

from runloom import logs
from runloom.plans.ingest import ingest
from runloom.plans.progress import Progress, StreamProgress, line, report
from runloom.plans.store import Store

DOC = "page_id string, title string, url string, space_key string, version int, labels array<string>, markdown string, content_hash string"


def test_reports():
    assert report(50, 200, 10.0) == {"done": 50, "total": 200, "share": 25.0, "rate": 5.0, "eta": 30.0}
    assert report(50, None, 10.0) == {"done": 50, "total": None, "share": None, "rate": 5.0, "eta": None}
    # Nothing done yet; all done; nothing to do; a task that ran twice.
    assert report(0, 200, 10.0)["eta"] is None and report(200, 200, 10.0)["eta"] == 0.0
    assert report(0, 0, 1.0) == {"done": 0, "total": 0, "share": 100.0, "rate": 0.0, "eta": 0.0}
    assert report(250, 200, 10.0)["done"] == 200
    assert line(report(50, 200, 10.0)) == "50 of 200 pages (25.0 %), 5.0 a second, 30 s left" and line(report(3, None, 1.0)) == "3 pages, 3.0 a second"


def test_ingest_tells_how_far_it_is(spark, tmp_path):
    docs = spark.createDataFrame([(f"p{i}", "T", "", "OPS", 1, [], f"## Part\n\nText {i}.", f"h{i}") for i in range(40)], DOC)
    store, p = Store(spark, str(tmp_path / "s"), 2), Progress(spark, every=0.05)
    ingest(store, docs.limit(30), progress=p)
    done = [r["done"] for r in p.rows]
    assert done == sorted(done) and len(done) > 1 and p.rows[-1]["total"] == 30 and p.rows[-1]["share"] == 100.0 and p.rows[-1]["eta"] == 0.0 and p.rows[-1]["rate"] > 0
    # A later run counts its own pages, of which unchanged ones are none.
    p.rows.clear()
    ingest(store, docs, progress=p)
    assert (p.rows[-1]["done"], p.rows[-1]["total"]) == (10, 10)


def test_streams_are_listened_to(spark, tmp_path):
    import time

    for i, n in enumerate((3, 5)):
        spark.range(n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.1)
    listener = StreamProgress("pages")
    spark.streams.addListener(listener)
    try:
        for name in ("pages", "others"):
            stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            q = stream.writeStream.queryName(name).format("noop").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
            q.awaitTermination(120)
        for _ in range(100):
            if len(listener.rows) == 2:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert [(r["query"], r["batch"], r["done"]) for r in listener.rows] == [("pages", 0, listener.rows[0]["pages"]), ("pages", 1, 8)]
    assert sorted(r["pages"] for r in listener.rows) == [3, 5] and all(r["rate"] > 0 for r in listener.rows)


def test_logs(capsys):
    out = io.StringIO()
    top = logs.setup("warning", "json", out)
    try:
        logging.getLogger("runloom.plans.x").info("not told")
        try:
            raise ValueError("bad")
        except ValueError:
            logging.getLogger("runloom.plans.x").warning("page %s", "p1", exc_info=True, extra={"page_id": "p1"})
        r = json.loads(out.getvalue())
        assert (r["level"], r["logger"], r["event"], r["page_id"]) == ("warning", "runloom.plans.x", "page p1", "p1") and "ValueError: bad" in r["exception"] and "time" in r
        logs.setup("info", "console", out)
        assert len(top.handlers) == 1
        top.info("hello")
        assert out.getvalue().rstrip().endswith("INFO    runloom: hello")
        for bad in (("loud", "json"), ("info", "xml")):
            with pytest.raises(ValueError):
                logs.setup(*bad)
    finally:
        top.handlers.clear()
        top.setLevel(logging.NOTSET)
        top.propagate = True
