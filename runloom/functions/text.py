"""Scalar expressions over document text. All of them stay in Catalyst; what is named plain does the same to plain values."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, functions as F

# Section kinds, first match wins, case-insensitive (word-bounded alternatives).
KIND_PATTERNS = [
    ("rollback", r"roll ?back|revert|undo|back ?out"),
    ("escalation", r"escalat\w*|on[- ]?call|contact|who to (call|page)|paging|ownership"),
    ("verification", r"verif\w*|validat\w*|confirm|post[- ]?check|smoke test|health ?check"),
    ("remediation", r"remediat\w*|mitigat\w*|resolution|resolv\w*|fix|repair|recover\w*|runbook steps|steps?|procedure|action plan|how to"),
    ("diagnosis", r"diagnos\w*|triage|investigat\w*|debug\w*|troubleshoot\w*|root cause|analysis|checks?"),
    ("symptoms", r"symptom\w*|signal\w*|alert\w*|detection|what you('ll)? see|indicator"),
    ("impact", r"impact|blast radius|severity|customer effect|sla|slo"),
    ("prerequisites", r"prerequisit\w*|before you (begin|start)|requirements?|access|permissions?"),
    ("references", r"reference\w*|see also|links?|related|appendix|further reading"),
    ("overview", r"overview|summary|description|purpose|scope|about|introduction|context"),
]
OTHER = "other"

#: Unicode white space at either end.
_EDGES = r"(?U)^\s+|\s+$"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, _EDGES, "")


def squeeze(x: Column) -> Column:
    """White space runs become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def word_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"(?U)\S+"))


def content_hash(markdown: Column) -> Column:
    return F.substring(F.sha2(markdown, 256), 1, 16)


def chunk_id(page_id: Column, section_index: Column, chunk_index: Column) -> Column:
    key = F.concat_ws(":", page_id, section_index.cast("string"), chunk_index.cast("string"))
    return F.substring(F.sha2(key, 256), 1, 24)


def plain_chunk_id(page_id: str, section_index: int, chunk_index: int) -> str:
    """``chunk_id`` of plain values."""
    return hashlib.sha256(f"{page_id}:{section_index}:{chunk_index}".encode()).hexdigest()[:24]


def breadcrumb(path: Column, title: Column) -> Column:
    return F.when(F.size(path) > 0, F.concat_ws(" > ", path)).otherwise(title)


def citation(title: Column, crumb: Column, url: Column) -> Column:
    return F.concat(title, F.lit(" — "), crumb, F.lit(" ("), url, F.lit(")"))


def embed_text(title: Column, crumb: Column, kind: Column, body: Column) -> Column:
    """The body in its context, which is what gets embedded and indexed."""
    return F.concat(F.lit("Runbook: "), title, F.lit("\nSection: "), crumb, F.lit("\nType: "), kind, F.lit("\n\n"), body)


def token_estimate(x: Column) -> Column:
    """The larger of a character-based and a word-based estimate; 0 for the empty text."""
    by_chars = F.floor(F.length(x) / 4) + 1
    by_words = F.floor(word_count(x) * F.lit(1.3)) + 1
    return F.when(F.length(x) == 0, 0).otherwise(F.greatest(by_chars, by_words)).cast("int")


def token_fallback(x: Column) -> Column:
    """What an embedder without a tokenizer of its own counts."""
    return F.greatest(F.floor(F.length(x) / 4), word_count(x).cast("long")).cast("int")


def section_kind(title: Column) -> Column:
    cases = [(kind, title.rlike(rf"(?iU)\b({pattern})\b")) for kind, pattern in KIND_PATTERNS]
    chain = reduce(lambda c, k: c.when(k[1], k[0]), cases[1:], F.when(cases[0][1], cases[0][0]))
    return F.coalesce(chain, F.lit(OTHER))


def inherited_kind(title: Column, path: Column) -> Column:
    """A section's own kind, else that of its nearest ancestor that has one."""
    above = F.reverse(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))))
    known = F.filter(F.transform(above, section_kind), lambda k: k != OTHER)
    own = section_kind(title)
    return F.when(own != OTHER, own).otherwise(F.coalesce(F.get(known, F.lit(0)), F.lit(OTHER)))


def preview(x: Column, limit: int = 400) -> Column:
    flat = squeeze(x)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


def vector_literal(v: Column) -> Column:
    """A vector as text, seven decimals each."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.format_string("%.7f", x.cast("double"))), ","), F.lit("]"))
