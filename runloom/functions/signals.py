"""Identifiers in a query, and the query variants that are run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import squeeze

# Identifier patterns (Unicode classes), HTTP codes that carry meaning, log levels.
EXCEPTION = r"(?U)\b([A-Za-z_][\w.]*(?:Exception|Error|Failure|Fault|Timeout))\b"
HTTP = r"(?U)\b(?:status(?:[ _-]?code)?[ =:]*)?([1-5]\d{2})\b"
ERROR_CODE = r"(?U)\b([A-Z][A-Z0-9]{2,}(?:_[A-Z0-9]+)*)\b"
QUALIFIED = r"(?U)\b(\w+(?:\.\w+){2,})\b"
PATH = r"(?U)(/(?:[\w.-]+/){1,}[\w.-]+)"
RESOURCE = r"(?U)\b([a-z0-9]+(?:-[a-z0-9]+){2,})\b"
HTTP_CODES = "400 401 403 404 409 413 429 500 502 503 504 507".split()
LEVELS = "ERROR WARN INFO DEBUG FATAL TRACE CRITICAL NULL TRUE FALSE".split()

MOST_SIGNALS = 6
MOST_CHARS = 600


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def signals(text: Column, limit: int = MOST_SIGNALS) -> Column:
    first = lambda xs: F.slice(F.array_distinct(xs), 1, limit)
    return F.struct(
        first(_found(text, EXCEPTION)).alias("exceptions"),
        first(F.filter(_found(text, ERROR_CODE), lambda c: (F.length(c) >= 4) & ~c.isin(LEVELS))).alias("error_codes"),
        first(F.filter(_found(text, HTTP), lambda c: c.isin(HTTP_CODES))).alias("http_codes"),
        first(F.filter(_found(text, QUALIFIED), lambda q: ~F.replace(q, F.lit("."), F.lit("")).rlike(r"(?U)^\d+$"))).alias("qualified_names"),
        first(F.filter(_found(text, RESOURCE), lambda r: F.length(r) >= 8)).alias("resources"),
        first(_found(text, PATH)).alias("paths"),
    )


def signal_terms(s: Column) -> Column:
    groups = ("exceptions", "error_codes", "http_codes", "qualified_names", "resources", "paths")
    return F.array_distinct(F.concat(*[s[g] for g in groups]))


def variants(text: Column, limit: int = MOST_CHARS) -> Column:
    """The text cut to ``limit``; its identifiers; the head of a text that was cut."""
    clean = squeeze(F.coalesce(text, F.lit("")))
    return _variants(clean, F.array_join(signal_terms(signals(clean)), " "), limit)


def _variants(clean: Column, found: Column, limit: int = MOST_CHARS) -> Column:
    """Of a squeezed text and its identifiers."""
    main = F.substring(clean, 1, limit)
    # No more than three parts: what follows the second sentence is not looked at.
    head = F.substring(F.array_join(F.slice(F.split(clean, r"\. ", 3), 1, 2), " "), 1, limit)
    second = F.when(found != "", found)
    third = F.when((F.length(clean) > limit) & (head != "") & (head != main) & (head != found), head)
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(main, second, third)))


def query_variants(queries: DataFrame) -> DataFrame:
    """query_id, text -> query_id, ord, variant."""
    # Steps of their own, as each of these columns is used several times and costs a pass of patterns over the text.
    q = queries.select("query_id", squeeze(F.coalesce("text", F.lit(""))).alias("clean"))
    q = q.select("query_id", "clean", signals(F.col("clean")).alias("signals"))
    q = q.select("query_id", "clean", F.array_join(signal_terms(F.col("signals")), " ").alias("found"))
    return q.select("query_id", F.posexplode(_variants(F.col("clean"), F.col("found"))).alias("ord", "variant"))
