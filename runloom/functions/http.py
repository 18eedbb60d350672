"""JSON over HTTP, with patience: 429, 5xx and failures in transport are tried again, with growing pauses or as long as the server asks for."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable

TIMEOUT, TRIES, LONGEST_PAUSE = 45, 5, 30.0


def get_json(url: str, headers: dict[str, str], opener: Callable = urllib.request.urlopen, pause: Callable[[float], None] = time.sleep, data: dict | None = None) -> dict:
    """The answer to a GET, or with ``data`` to a POST of it. Other client errors are raised at once."""
    body = None if data is None else json.dumps(data).encode()
    headers = headers if data is None else headers | {"Content-Type": "application/json"}
    for attempt in range(1, TRIES + 1):
        try:
            with opener(urllib.request.Request(url, body, headers), timeout=TIMEOUT) as r:
                return json.loads(r.read())
        except urllib.error.HTTPError as e:
            if e.code != 429 and e.code < 500:
                raise
            failure: Exception = e
            asked = (e.headers or {}).get("Retry-After") or ""
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            failure, asked = e, ""
        if attempt < TRIES:
            pause(min(max(2.0 ** (attempt - 1), float(asked) if asked.isdigit() else 0.0), LONGEST_PAUSE))
    raise failure
