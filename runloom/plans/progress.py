"""Progress of long runs: how many pages are done, their share, the rate and the time that is left.

``Progress`` follows a batch by an accumulator that its tasks feed as they end; ``StreamProgress`` listens to streaming queries.
Both keep their last reports as ``rows`` and write each to the log.
"""

from __future__ import annotations

import logging
import threading
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger(__name__)

#: Seconds between reports; reports that are kept.
EVERY, KEPT = 10.0, 1000


def report(done: int, total: int | None, seconds: float) -> dict:
    """done, total, share (percent), rate (a second), eta (seconds). Without a total, or before the first page, there is no share or no eta.

    Tasks that run again count again, so that ``done`` is held to the total.
    """
    done = done if total is None else min(done, total)
    rate = done / seconds if seconds > 0 else 0.0
    share = None if total is None else 100.0 * done / total if total else 100.0
    left = None if total is None or (not rate and done < total) else (total - done) / rate if rate else 0.0
    return {"done": done, "total": total, "share": share, "rate": rate, "eta": left}


def line(r: dict) -> str:
    parts = [f"{r['done']} pages" if r["total"] is None else f"{r['done']} of {r['total']} pages ({r['share']:.1f} %)", f"{r['rate']:.1f} a second"]
    return ", ".join(parts + ([] if r["eta"] is None else [f"{r['eta']:.0f} s left"]))


class Progress:
    """``with progress.over(total):`` reports every ``every`` seconds while tasks add to ``done``, and once at the end."""

    def __init__(self, spark: SparkSession, every: float = EVERY, clock: Callable[[], float] = time.monotonic) -> None:
        self.done = spark.sparkContext.accumulator(0)
        self.every, self.clock = every, clock
        self.rows: deque[dict] = deque(maxlen=KEPT)
        self._total: int | None = None
        self._before = 0

    def over(self, total: int | None) -> Progress:
        self._total, self._before = total, self.done.value
        return self

    def tell(self) -> dict:
        r = report(self.done.value - self._before, self._total, self.clock() - self._start)
        self.rows.append(r)
        log.info("%s", line(r), extra={"progress": r})
        return r

    def __enter__(self) -> Progress:
        self._start, self._end = self.clock(), threading.Event()

        def watch() -> None:
            while not self._end.wait(self.every):
                self.tell()

        self._watch = threading.Thread(target=watch, name="progress", daemon=True)
        self._watch.start()
        return self

    def __exit__(self, *_) -> None:  # noqa: ANN002
        self._end.set()
        self._watch.join()
        self.tell()


class StreamProgress(StreamingQueryListener):
    """A report for each micro-batch of all queries of a session, or of the one of a given name; empty batches have none."""

    def __init__(self, name: str | None = None) -> None:
        self.name = name
        self.rows: deque[dict] = deque(maxlen=KEPT)
        self._done: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: ANN001
        self._done[str(event.runId)] = 0

    def onQueryProgress(self, event) -> None:  # noqa: ANN001
        p = event.progress
        if (self.name and p.name != self.name) or not p.numInputRows:
            return
        run = str(p.runId)
        self._done[run] = self._done.get(run, 0) + p.numInputRows
        r = {"query": p.name or str(p.id), "batch": p.batchId, "pages": p.numInputRows, "done": self._done[run], "rate": p.processedRowsPerSecond}
        self.rows.append(r)
        log.info("batch %d: %d pages, %d so far, %.1f a second", r["batch"], r["pages"], r["done"], r["rate"], extra={"progress": r})

    def onQueryIdle(self, event) -> None:  # noqa: ANN001
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001
        self._done.pop(str(event.runId), None)
        if event.exception:
            log.error("a streaming query ended: %s", event.exception)
