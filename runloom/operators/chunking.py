"""Markdown documents into chunks that keep procedures, code and tables whole.

A document is split by its headings, a section into blocks, and blocks are packed
to a token budget. The state machines need Python; they run over Arrow batches.
A document that fails yields a row with its error in place of chunks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, functions as F

from ..functions.memory import release, small_batches
from ..functions.text import KIND_PATTERNS, OTHER

# Markdown line patterns, and where a sentence ends.
HEADING = re.compile(r"^(#{1,6})\s+(.*)$")
LIST_ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+")
TABLE_ROW = re.compile(r"^\s*\|")
QUOTE = re.compile(r"^\s*>")
SENTENCE_END = re.compile(r"(?<=[.!?:])\s+(?=[A-Z0-9`\-*])")

_KINDS = [(kind, re.compile(rf"\b({p})\b", re.I)) for kind, p in KIND_PATTERNS]
FENCE = "```"
SLACK = 1.15
#: Documents that a task takes apart before it hands their chunks on.
DOCS = 64

Counter = Callable[[str], int]


def estimate(text: str) -> int:
    return max(int(len(text) / 4) + 1, int(len(text.split()) * 1.3) + 1) if text else 0


def fallback(text: str) -> int:
    return max(len(text) // 4, len(text.split()))


COUNTERS: dict[str, Counter] = {"estimate": estimate, "fallback": fallback}


def kind_of(title: str) -> str:
    return next((k for k, p in _KINDS if p.search(title)), OTHER) if title.strip() else OTHER


@dataclass
class Section:
    title: str
    path: list[str]
    index: int
    lines: list[str]


def fence_length(line: str) -> int:
    s = line.strip()
    return len(s) - len(s.lstrip("`")) if s.startswith(FENCE) else 0


def sections(markdown: str, title: str) -> list[Section]:
    """Heading-delimited sections; their numbers count empty ones too. Fences hide headings."""
    out = [Section(title, [title], 0, [])]
    stack: list[tuple[int, str]] = []
    fence = 0
    for line in markdown.split("\n"):
        n = fence_length(line)
        if fence:
            fence = 0 if n >= fence else fence
        elif n:
            fence = n
        elif m := HEADING.match(line.strip()):
            level, name = len(m[1]), m[2].strip()
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, name))
            path = [t for _, t in stack]
            if path[0] == title:
                path = path[1:]
            out.append(Section(name, path or [title], len(out), []))
            continue
        out[-1].lines.append(line)
    return [s for s in out if any(x.strip() for x in s.lines)]


def blocks(lines: list[str]) -> list[tuple[str, str]]:
    """(kind, text) of a section's blocks: code, table, list, quote, paragraph."""
    out, i, n = [], 0, len(lines)

    def take(kind: str, until: Callable[[int], bool]) -> None:
        nonlocal i
        first = i
        i += 1
        while i < n and not until(i):
            i += 1
        text = "\n".join(lines[first:i])
        if text := text.strip() if kind == "paragraph" else text.rstrip() if kind == "quote" else text:
            out.append((kind, text))

    def list_ends(k: int) -> bool:
        line = lines[k]
        if not line.strip():
            return not (k + 1 < n and LIST_ITEM.match(lines[k + 1]))
        return not (LIST_ITEM.match(line) or line.startswith(("  ", "\t")))

    def quote_ends(k: int) -> bool:
        """A blank line inside a quote is part of it if the next line is."""
        return not (QUOTE.match(lines[k]) or not lines[k].strip() and k + 1 < n and QUOTE.match(lines[k + 1]))

    def starts_other(k: int) -> bool:
        x = lines[k]
        return not x.strip() or bool(fence_length(x) or TABLE_ROW.match(x) or LIST_ITEM.match(x) or QUOTE.match(x))

    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
        elif size := fence_length(line):
            first = i
            i += 1
            while i < n and fence_length(lines[i]) < size:
                i += 1
            i = min(i + 1, n)
            out.append(("code", "\n".join(lines[first:i])))
        elif TABLE_ROW.match(line):
            take("table", lambda k: not TABLE_ROW.match(lines[k]))
        elif LIST_ITEM.match(line):
            take("list", list_ends)
        elif QUOTE.match(line):
            take("quote", quote_ends)
        else:
            take("paragraph", starts_other)
    return out


def _grouped(parts: list[str], glue: str, full: Callable[[str, str], bool]) -> list[str]:
    """Greedy runs of parts; ``full`` says of a run and the next part whether the run ends. A part too large by itself stays whole."""
    runs: list[list[str]] = []
    for p in parts:
        if runs and not full(glue.join(runs[-1]), p):
            runs[-1].append(p)
        else:
            runs.append([p])
    return [glue.join(r) for r in runs]


def split_code(text: str, most: int, count: Counter) -> list[str]:
    """Runs of lines, each in a fence of its own; parts of several are numbered below their fence."""
    lines = text.split("\n")
    if len(lines) < 3:
        return [text]
    closed = fence_length(lines[-1]) > 0 and not lines[-1].strip().strip("`")
    language = lines[0].strip().lstrip("`")
    body, end = (lines[1:-1], lines[-1]) if closed else (lines[1:], FENCE)  # an open fence keeps its last line
    room = most - count(f"{lines[0]}\n{end}") - 12
    runs = _grouped(body, "\n", lambda run, line: count(run) + count(line) > room)
    label = lambda i: f"\n<!-- code block part {i}/{len(runs)} -->" if len(runs) > 1 else ""
    return [f"{FENCE}{language}\n{run}\n{FENCE}{label(i)}" for i, run in enumerate(runs, 1)]


def split_list(text: str, most: int, count: Counter) -> list[str]:
    """Runs of top-level items; each part of several says that it is one."""
    items: list[str] = []
    for line in text.split("\n"):
        if LIST_ITEM.match(line) and not line.startswith(("  ", "\t")) or not items:
            items.append(line)
        else:
            items[-1] += "\n" + line
    runs = _grouped(items, "\n", lambda run, item: count(f"{run}\n{item}") > most)
    return runs if len(runs) < 2 else [f"{run}\n\n(continued — step list part {i}/{len(runs)})" for i, run in enumerate(runs, 1)]


def split_table(text: str, most: int, count: Counter) -> list[str]:
    lines = text.split("\n")
    head, rows = "\n".join(lines[:2]), lines[2:]
    if not rows:
        return [text]
    return [f"{head}\n{run}" for run in _grouped(rows, "\n", lambda run, row: count(f"{head}\n{run}\n{row}") > most)]


def split_prose(text: str, most: int, count: Counter) -> list[str]:
    """Runs of sentences. A sentence above the budget is cut between words, and its rest begins the next run."""
    out: list[str] = []
    now: list[str] = []
    over = lambda run, more: count(f"{run} {more}") > most
    for sentence in SENTENCE_END.split(text):
        if now and over(" ".join(now), sentence):
            out.append(" ".join(now))
            now = []
        if count(sentence) <= most:
            now.append(sentence)
        elif parts := _grouped(sentence.split(), " ", over):
            out += parts[:-1]
            now = parts[-1:]
    return [t for t in [*out, " ".join(now)] if t.strip()]


_SPLITTERS = {"code": split_code, "list": split_list, "table": split_table}


def pack(section: Section, most: int, least: int, overlap: int, count: Counter) -> list[str]:
    out: list[str] = []
    now = ""
    for kind, text in blocks(section.lines):
        size = count(text)
        if size > most:
            out += [now.strip()] if now else []
            now = ""
            out += [t.strip() for t in _SPLITTERS.get(kind, split_prose)(text, most, count)]
        elif now and count(now) + size > most:
            out.append(now.strip())
            now = text
        else:
            now = f"{now}\n\n{text}" if now else text
    if now:
        out.append(now.strip())
    merged: list[str] = []
    for t in out:
        if merged and count(t) < least and count(f"{merged[-1]}\n\n{t}") <= int(most * SLACK):
            merged[-1] = f"{merged[-1]}\n\n{t}"
        else:
            merged.append(t)
    if overlap <= 0:
        return merged
    return [t if not i else _with_tail(merged[i - 1], t, overlap, count) for i, t in enumerate(merged)]


def _with_tail(before: str, text: str, overlap: int, count: Counter) -> str:
    """Whole sentences from the end of the chunk before, unless its last paragraph has code in it."""
    if FENCE in before.rsplit("\n\n", 1)[-1]:
        return text
    tail: list[str] = []
    for s in reversed(SENTENCE_END.split(before.replace("\n", " ").strip())):
        if count(" ".join([s, *tail])) > overlap:
            break
        tail.insert(0, s)
    carried = " ".join(tail).strip()
    return f"{carried}\n\n{text}" if carried else text


def chunk_document(doc: dict, most: int, least: int, overlap: int, count: Counter) -> list[dict]:
    out = []
    title = doc["title"]
    for s in sections(doc["markdown"] or "", title):
        own = kind_of(s.title)
        kind = own if own != OTHER else next((k for p in reversed(s.path[:-1]) if (k := kind_of(p)) != OTHER), OTHER)
        crumb = " > ".join(s.path)
        for i, body in enumerate(pack(s, most, least, overlap, count)):
            if not body.strip():
                continue
            text = f"Runbook: {title}\nSection: {crumb}\nType: {kind}\n\n{body}"
            key = hashlib.sha256(f"{doc['page_id']}:{s.index}:{i}".encode()).hexdigest()[:24]
            out.append({
                "chunk_id": key, "page_id": doc["page_id"], "page_title": title, "page_url": doc["url"], "space_key": doc["space_key"], "page_version": doc["version"],
                "content_hash": doc["content_hash"], "section_path": s.path, "section_kind": kind, "section_index": s.index, "chunk_index": i, "body_text": body,
                "embed_text": text, "token_count": count(text), "labels": doc["labels"] or [], "error": None,
            })
    return out


SCHEMA = (
    "chunk_id string, page_id string, page_title string, page_url string, space_key string, page_version int, content_hash string, section_path array<string>, "
    "section_kind string, section_index int, chunk_index int, body_text string, embed_text string, token_count int, labels array<string>, error string"
)
_ARROW = pa.schema([
    *[(c, pa.string()) for c in ("chunk_id", "page_id", "page_title", "page_url", "space_key")], ("page_version", pa.int32()), ("content_hash", pa.string()),
    ("section_path", pa.list_(pa.string())), ("section_kind", pa.string()), ("section_index", pa.int32()), ("chunk_index", pa.int32()), ("body_text", pa.string()),
    ("embed_text", pa.string()), ("token_count", pa.int32()), ("labels", pa.list_(pa.string())), ("error", pa.string()),
])


def chunk_documents(docs: DataFrame, most: int = 512, least: int = 96, overlap: int = 64, counter: str = "fallback", done: Accumulator | None = None) -> DataFrame:
    """page_id, title, url, space_key, version, labels, markdown, content_hash -> chunks. ``done`` counts documents as tasks end."""
    if least >= most:
        raise ValueError("the least chunk size must be below the largest")
    names = ["page_id", "title", "url", "space_key", "version", "labels", "markdown", "content_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = COUNTERS[counter]
        for b in batches:
            for lo in range(0, len(b), DOCS):
                rows: list[dict] = []
                for doc in b.slice(lo, DOCS).to_pylist():
                    try:
                        rows += chunk_document(doc, most, least, overlap, count)
                    except Exception as e:  # one document's failure is a row, not the end of the job
                        rows.append({"page_id": doc["page_id"], "error": f"{type(e).__name__}: {e}"})
                yield from pa.Table.from_pylist(rows, schema=_ARROW).to_batches()
            if done is not None:
                done.add(len(b))
        release()

    small_batches(docs.sparkSession)
    return docs.select(*names).mapInArrow(run, SCHEMA)


def oversize(chunks: DataFrame, most: int = 512, slack: float = 1.2) -> DataFrame:
    return chunks.filter(F.col("token_count") > most * slack)
