"""Pages of a wiki's content API as a Python data source, for batches and for streams.

    content_api.register(spark)
    spark.read.format("content_api").options(base_url=..., spaces="OPS,DEV", token=...).load()
    spark.readStream.format("content_api").options(...).load()

A space of many pages is read by several tasks. The creation times of the results at even distances cut it into ranges, which stay the same when
pages come or go while they are read, as result offsets would not. Filters on page_id, space_key and updated_at reach the server, and
Spark applies them once more. A stream's offset is the time of the last change; a batch has the pages changed after one offset up to the next.

Requests that fail with 429, 5xx or in transport are tried again, with growing pauses or as long as the server asks for;
other client errors end the read.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

from ..functions.http import get_json

PAGE_SIZE = 50
#: Pages of a partition, more where there would be over MOST_PARTITIONS of them in a space.
PER_PARTITION, MOST_PARTITIONS = 1000, 200
#: The server reads times in its user's zone, so a filter by time is sent with this to spare.
ANY_ZONE = timedelta(days=1)
EXPAND = "body.storage,version,space,ancestors,metadata.labels,history,history.lastUpdated"


def quote(value: str) -> str:
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


def page_query(spaces: list[str] | None = None, labels: list[str] | None = None, override: str = "") -> str:
    """The search expression for pages of given spaces and labels."""
    if override.strip():
        return override.strip()
    parts = ["type = page"]
    for name, values in (("space", spaces), ("label", labels)):
        if values:
            parts.append(f"{name} in ({', '.join(map(quote, values))})")
    return " and ".join(parts)


def verify(base_url: str, token: str, opener: Callable = urllib.request.urlopen, pause: Callable[[float], None] = time.sleep) -> str:
    """The name of the user that the token belongs to; a token that is refused raises PermissionError."""
    headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    try:
        user = get_json(f"{base_url.rstrip('/')}/rest/api/user/current", headers, opener, pause)
    except urllib.error.HTTPError as e:
        if e.code in (401, 403):
            raise PermissionError(f"{base_url} refuses the token ({e.code})") from e
        raise
    return user.get("displayName") or user.get("username") or ""


def count_pages(answer: dict) -> int | None:
    """The number of matches that an answer tells, for progress only."""
    return answer.get("totalSize", answer.get("size"))


def moment(text: str | None) -> datetime | None:
    """A time of the API; without a zone it is UTC. None if it can't be read."""
    try:
        t = datetime.fromisoformat(text or "")
    except ValueError:
        return None
    return t.replace(tzinfo=t.tzinfo or timezone.utc).astimezone(timezone.utc)


def changed(raw: dict) -> datetime | None:
    return moment(((raw.get("history") or {}).get("lastUpdated") or {}).get("when")) or moment((raw.get("version") or {}).get("when"))


def minute(t: datetime) -> str:
    return f'"{t:%Y-%m-%d %H:%M}"'


@dataclass
class _Part(InputPartition):
    """Results of a query, or one page; of these, what changed after one time up to another."""

    query: str = ""
    page_id: str = ""
    after: str = ""
    until: str = ""


class Client:
    """The API as the options say: base_url, token, spaces, labels, cql, page_id, per_partition."""

    def __init__(self, options: dict[str, str]) -> None:
        o = self.options = dict(options)
        self.base = o["base_url"].rstrip("/")
        self.headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {o['token']}"} if o.get("token") else {})
        self.per_partition = int(o.get("per_partition", PER_PARTITION))

    def names(self, option: str) -> list[str]:
        return [x.strip() for x in self.options.get(option, "").split(",") if x.strip()]

    def query(self, spaces: list[str]) -> str:
        return page_query(spaces, self.names("labels"), self.options.get("cql", ""))

    def search(self, query: str, limit: int = PAGE_SIZE, start: int = 0, expand: str = EXPAND) -> dict:
        asked = {"cql": query, "limit": limit} | ({"start": start} if start else {}) | ({"expand": expand} if expand else {})
        return get_json(f"{self.base}/rest/api/content/search?{urllib.parse.urlencode(asked)}", self.headers)

    def count(self, query: str) -> int | None:
        """How many pages match, if the server tells."""
        return count_pages(self.search(query, 1, expand=""))

    def page(self, page_id: str) -> dict:
        raw = get_json(f"{self.base}/rest/api/content/{urllib.parse.quote(page_id, safe='')}?expand={EXPAND}", self.headers)
        if not ((raw.get("body") or {}).get("storage") or {}).get("value"):
            raise ValueError(f"page {page_id} has no body")
        return raw

    def results(self, query: str) -> Iterator[dict]:
        """All results, page by page of the answer."""
        answer = self.search(query)
        while rows := answer.get("results", []):
            yield from rows
            following = (answer.get("_links") or {}).get("next")
            if not following:
                return
            answer = get_json(following if "://" in following else f"{self.base}/{following.lstrip('/')}", self.headers)

    def cut(self, query: str) -> list[str]:
        """Queries that share out the results of one."""
        if " order by " in f" {query.lower()} ":
            return [query]  # nothing can be added behind an order
        first = self.search(query, 1, expand="")
        total = count_pages(first) if "totalSize" in first else None
        if not total or total <= self.per_partition or "cursor=" in (first.get("_links") or {}).get("next", ""):
            return [query]  # few, or a server that can't go to the n-th result
        step = max(self.per_partition, -(-total // MOST_PARTITIONS))
        at = (self.search(f"{query} order by created", 1, n, "history").get("results") for n in range(step, total, step))
        times = (moment((rows[0].get("history") or {}).get("createdDate")) for rows in at if rows)
        bounds = sorted({minute(t) for t in times if t})
        # An expression of the user's own may hold an "or".
        inside = f"({query})" if bounds else query
        return [inside + "".join([f" and created >= {lo}" if lo else "", f" and created < {hi}" if hi else ""]) for lo, hi in zip(["", *bounds], [*bounds, ""])]


def rows_of(client: Client, part: _Part) -> Iterator[tuple]:
    found = [client.page(part.page_id)] if part.page_id else client.results(part.query)
    after, until = moment(part.after), moment(part.until)
    for raw in found:
        t = changed(raw)
        if (after and t and t <= after) or (until and t and t > until) or (after and not t):
            continue
        yield str(raw.get("id", "")), (raw.get("space") or {}).get("key"), t, json.dumps(raw)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.client = Client(options)
        self.spaces: set[str] | None = set(self.client.names("spaces")) or None
        self.ids: set[str] | None = None
        self.since: datetime | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrow what is asked for. Spark applies all filters again, as the server's are coarser."""
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if isinstance(f, (EqualTo, In)) and name in ("page_id", "space_key"):
                values = {v for v in (f.value if isinstance(f, In) else (f.value,)) if isinstance(v, str)}
                if name == "page_id":
                    self.ids = values if self.ids is None else self.ids & values
                elif not self.client.options.get("cql"):
                    self.spaces = values if self.spaces is None else self.spaces & values
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and name == "updated_at" and isinstance(f.value, datetime):
                t = f.value if f.value.tzinfo else f.value.replace(tzinfo=timezone.utc)
                self.since = max(t, self.since or t)
            yield f

    def partitions(self) -> list[_Part]:
        c = self.client
        if c.options.get("page_id"):
            return [_Part(page_id=c.options["page_id"])]
        if self.spaces == set() or self.ids == set():
            return []
        own = bool(c.options.get("cql"))
        narrow = "" if self.since is None else f" and lastmodified >= {minute(self.since - ANY_ZONE)}"
        narrow += "" if self.ids is None else f" and id in ({', '.join(map(quote, sorted(self.ids)))})"
        queries = [c.query([])] if self.spaces is None or own else [c.query([s]) for s in sorted(self.spaces)]
        if narrow and not any(" order by " in f" {q.lower()} " for q in queries):
            queries = [f"({q}){narrow}" for q in queries]
        # Spark asks for at least one partition; one without a query has no rows.
        return [_Part(query=part) for q in queries for part in c.cut(q)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        return rows_of(self.client, partition) if partition and (partition.query or partition.page_id) else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.client = Client(options)
        self.query = self.client.query(self.client.names("spaces"))
        self.latest = ""

    def initialOffset(self) -> dict:
        return {"until": ""}

    def latestOffset(self) -> dict:
        rows = self.client.search(f"{self.query} order by lastmodified desc", 1, expand="version,history.lastUpdated").get("results") or [{}]
        t = changed(rows[0])
        self.latest = max(self.latest, t.isoformat(timespec="microseconds") if t else "")
        return {"until": self.latest}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        after, until = start["until"], end["until"]
        self.latest = max(self.latest, after)
        if until <= after:
            return [_Part()]
        q = f"({self.query}) and lastmodified >= {minute(moment(after) - ANY_ZONE)}" if after else self.query
        return [_Part(query=part, after=after, until=until) for part in self.client.cut(q)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        return rows_of(self.client, partition) if partition.query else iter(())


class ContentApi(DataSource):
    """Rows of page_id, space_key, updated_at and ``value``: a page's JSON, for ``from_json`` with files.PAYLOAD."""

    @classmethod
    def name(cls) -> str:
        return "content_api"

    def schema(self) -> str:
        return "page_id string, space_key string, updated_at timestamp, value string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters through to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ContentApi)
