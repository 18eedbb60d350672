"""Logs of the driver: lines to read, or a JSON object each."""

from __future__ import annotations

import json
import logging
import sys
from datetime import datetime, timezone

#: What every record has; anything else was given by the caller as ``extra``.
_OWN = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime", "taskName"}


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        out = {"time": datetime.fromtimestamp(record.created, timezone.utc).isoformat(), "level": record.levelname.lower(), "logger": record.name, "event": record.getMessage()}
        out |= {k: v for k, v in vars(record).items() if k not in _OWN}
        if record.exc_info:
            out["exception"] = self.formatException(record.exc_info)
        return json.dumps(out, default=str, ensure_ascii=False)


def setup(level: str = "info", form: str = "console", stream=None) -> logging.Logger:  # noqa: ANN001
    """Send this package's logs to standard error (or ``stream``), once however often it is called; others' loggers stay as they are."""
    number = logging.getLevelNamesMapping().get(level.upper())
    if number is None or form not in ("console", "json"):
        raise ValueError(f"no log level {level!r} of the form {form!r}")
    handler = logging.StreamHandler(stream or sys.stderr)
    handler.setFormatter(JsonLines() if form == "json" else logging.Formatter("%(asctime)s %(levelname)-7s %(name)s: %(message)s", "%H:%M:%S"))
    top = logging.getLogger("runloom")
    top.handlers[:] = [handler]
    top.setLevel(number)
    top.propagate = False
    return top
