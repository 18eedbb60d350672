"""Metadata filters: field -> value or values, all of which must hold."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, functions as F

FIELDS = ("page_id", "space_key", "section_kind", "page_title", "content_hash")


def predicate(filters: dict[str, Any] | None, fields: tuple[str, ...] = FIELDS) -> Column | None:
    """A scalar is an equality, a collection a membership; an empty collection says nothing.

    The result is made of comparisons with literals, which reach the Parquet scan.
    """
    clauses = []
    for name, value in (filters or {}).items():
        if name not in fields:
            raise ValueError(f"unknown filter field {name!r}; allowed: {', '.join(fields)}")
        if isinstance(value, (list, tuple, set, frozenset)):
            if value:
                clauses.append(F.col(name).isin(sorted(value)))
        else:
            clauses.append(F.col(name) == F.lit(value))
    return reduce(lambda a, b: a & b, clauses) if clauses else None


def apply(df, filters: dict[str, Any] | None, fields: tuple[str, ...] = FIELDS):
    p = predicate(filters, fields)
    return df if p is None else df.filter(p)
