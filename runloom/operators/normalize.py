"""Wiki storage XHTML to Markdown.

A tree is built with the standard parser (CDATA is set aside first, so that results don't hang on
the parser's version), then rendered by one function per kind of element. Runs over Arrow
batches; a page that fails gives an error in place of its text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Macros and elements by what becomes of them.
ADMONITIONS = {"info": "INFO", "note": "NOTE", "tip": "TIP", "warning": "WARNING", "panel": "PANEL", "caution": "CAUTION"}
SKIPPED_MACROS = "toc children pagetree livesearch recently-updated contributors anchor gallery".split()
CODE_MACROS, ISSUE_MACROS = ("code", "noformat"), ("jira", "jiraissues")
TRANSPARENT = "ac:layout ac:layout-section ac:layout-cell ac:rich-text-body".split()
SILENT = "ac:parameter ac:placeholder ac:task-status ri:page ri:attachment ri:user script style".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BOLD, ITALIC, STRUCK = ("strong", "b"), ("em", "i"), ("del", "s", "strike")

_SPACES = re.compile(r"[ \t\r\f\v]+")
_CDATA = re.compile(r"<!\[CDATA\[(.*?)\]\]>", re.S)
#: Private-use characters around the number of a CDATA section that is set aside.
_OPEN, _SHUT = chr(0xE000), chr(0xE001)
_HELD = re.compile(f"{_OPEN}([0-9]+){_SHUT}")


class Node:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str] | None = None) -> None:
        self.name, self.attrs, self.children = name, attrs or {}, []

    def find(self, *names: str) -> Node | None:
        return next((n for n in self.walk() if n.name in names), None)

    def walk(self) -> Iterator[Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)


class _Builder(HTMLParser):
    def __init__(self, held: list[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open, self.held = [self.root], held

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(n)
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        if any(n.name == tag for n in self.open[1:]):
            while self.open.pop().name != tag:
                pass

    def handle_data(self, data):
        self.open[-1].children.append(_HELD.sub(lambda m: self.held[int(m[1])] if int(m[1]) < len(self.held) else m[0], data))

    def handle_decl(self, decl):
        self.open[-1].children.append(decl.split(" ", 1)[-1])


def tree(source: str) -> Node:
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append(m[1])
        return f"{_OPEN}{len(held) - 1}{_SHUT}"

    b = _Builder(held)
    b.feed(_CDATA.sub(hold, source))
    b.close()
    return b.root


def to_markdown(source: str | None) -> str:
    if not source or not source.strip():
        return ""
    return re.sub(r"\n{3,}", "\n\n", render_all(tree(source), 0)).strip() + "\n"


def render_all(n: Node, depth: int) -> str:
    return "".join(render(c, depth) for c in n.children)


def spaced(text: str) -> str:
    """Runs of ASCII blanks become one space; other white space stays."""
    return _SPACES.sub(" ", text)


def flat(n: Node, depth: int = 0) -> str:
    """Children on one line."""
    return spaced(render_all(n, depth).replace("\n", " ")).strip()


def render(c: Node | str, depth: int) -> str:
    if isinstance(c, str):
        return spaced(c)
    rule = _RULES.get(c.name)
    return rule(c, depth) if rule else render_all(c, depth)


def _paragraph(n: Node, depth: int) -> str:
    return f"{t}\n\n" if (t := flat(n, depth)) else ""


def _heading(level: int) -> Callable[[Node, int], str]:
    return lambda n, d: f"\n{'#' * level} {t}\n\n" if (t := flat(n, d)) else ""


def _marked(mark: str) -> Callable[[Node, int], str]:
    return lambda n, d: f"{mark}{t}{mark}" if (t := flat(n, d)) else ""


def _inline_code(n: Node, depth: int) -> str:
    return f"`{t}`" if (t := spaced(n.text()).strip()) else ""


def _anchor(n: Node, depth: int) -> str:
    text, href = flat(n, depth), n.attrs.get("href", "").strip()
    if not text or not href or href.startswith("#"):
        return text or href
    return f"[{text}]({href})"


def fenced(body: str, language: str = "") -> str:
    body = body.strip("\n")
    if not body.strip():
        return ""
    mark = "```"
    while mark in body:
        mark += "`"
    return f"\n{mark}{language}\n{body}\n{mark}\n\n"


def _pre(n: Node, depth: int) -> str:
    code = n.find("code")
    names = code.attrs.get("class", "").split() if code else []
    return fenced(n.text(), next((c[9:] for c in names if c.startswith("language-")), ""))


def quoted(body: str) -> str:
    return "\n".join(f"> {x}" if x else ">" for x in body.split("\n"))


def _quote(n: Node, depth: int) -> str:
    return f"{quoted(t)}\n\n" if (t := render_all(n, depth).strip()) else ""


def _list(ordered: bool) -> Callable[[Node, int], str]:
    def rule(n: Node, depth: int) -> str:
        out: list[str] = []
        for k, item in enumerate((c for c in n.children if isinstance(c, Node) and c.name == "li"), 1):
            mark = "    " * depth + (f"{k}. " if ordered else "- ")
            inner = [isinstance(c, Node) and c.name in ("ul", "ol") for c in item.children]
            first, *more = "".join(render(c, depth + 1) for c, nested in zip(item.children, inner) if not nested).strip().split("\n")
            out.append(mark + first.strip())
            out += [" " * len(mark) + x if x.strip() else "" for x in more]  # hanging indent: still the same item
            for c, nested in zip(item.children, inner):
                if nested:
                    out += render(c, depth + 1).rstrip("\n").split("\n")
        return "\n".join(out) + "\n\n" if out else ""

    return rule


def _table(n: Node, depth: int) -> str:
    """The first row of header cells only is the header, wherever it stands; without one, a blank header keeps the table one."""
    head: list[str] | None = None
    rows: list[list[str]] = []
    for row in (r for r in n.walk() if r.name == "tr"):
        cells = [c for c in row.children if isinstance(c, Node) and c.name in ("td", "th")] or [c for c in row.walk() if c.name in ("td", "th")]
        text = [flat(c, depth).replace("|", "\\|") for c in cells]
        if not any(text):
            continue
        if head is None and all(c.name == "th" for c in cells):
            head = text
        else:
            rows.append(text)
    if not rows and head is None:
        return ""
    width = max(len(r) for r in [*rows, head or []])
    line = lambda r: "| " + " | ".join([*r, *[""] * (width - len(r))]) + " |"
    return "\n".join([line(head or []), "|" + "|".join([" --- "] * width) + "|", *map(line, rows)]) + "\n\n"


def _parameter(n: Node, key: str) -> str:
    return next((c.text().strip() for c in n.walk() if c.name == "ac:parameter" and c.attrs.get("ac:name") == key), "")


def _macro(n: Node, depth: int) -> str:
    name = n.attrs.get("ac:name", "").lower()
    rich, plain = n.find("ac:rich-text-body"), n.find("ac:plain-text-body")
    if name in SKIPPED_MACROS:
        return ""
    if name in CODE_MACROS:
        return fenced((plain or n).text(), _parameter(n, "language") if name == "code" else "")
    if name in ADMONITIONS:
        title = _parameter(n, "title")
        body = render_all(rich, depth).strip() if rich else spaced(n.text()).strip()
        return f"\n{quoted(f'**{ADMONITIONS[name]}{": " + title if title else ""}**\n\n{body}')}\n\n" if body else ""
    if name == "expand":
        body = render_all(rich, depth).strip() if rich else ""
        return f"\n**{_parameter(n, 'title') or 'Details'}**\n\n{body}\n\n" if body else ""
    if name == "status":
        return f"`{t}`" if (t := _parameter(n, "title")) else ""
    if name in ISSUE_MACROS:
        return f"[Jira {k}]" if (k := _parameter(n, "key")) else "[Jira issue]"
    return render_all(rich, depth) if rich else plain.text() if plain else ""


def _attribute(n: Node, tag: str, name: str) -> str:
    found = n.find(tag)
    return found.attrs.get(name, "").strip() if found else ""


def _link(n: Node, depth: int) -> str:
    body = n.find("ac:link-body") or n.find("ac:plain-text-link-body")
    text = spaced(body.text()).strip() if body else ""
    target = _attribute(n, "ri:attachment", "ri:filename") if n.find("ri:attachment") else _attribute(n, "ri:page", "ri:content-title")
    return f"{text} (see: {target})" if text and target and text != target else text or target


def _image(n: Node, depth: int) -> str:
    name = _attribute(n, "ri:attachment", "ri:filename") or _attribute(n, "ri:url", "ri:value")
    return f"[image: {name}]" if name else ""


def _tasks(n: Node, depth: int) -> str:
    out = []
    for t in (c for c in n.children if isinstance(c, Node) and c.name == "ac:task"):
        status, body = t.find("ac:task-status"), t.find("ac:task-body")
        if text := flat(body, depth) if body else "":
            done = "x" if status and status.text().strip().lower() == "complete" else " "
            out.append(f"- [{done}] {text}")
    return "\n".join(out) + "\n\n" if out else ""


_RULES: dict[str, Callable[[Node, int], str]] = {
    "p": _paragraph, "br": lambda n, d: "\n", "hr": lambda n, d: "\n---\n\n", "code": _inline_code, "a": _anchor, "pre": _pre,
    "blockquote": _quote, "ul": _list(False), "ol": _list(True), "table": _table, "ac:structured-macro": _macro,
    "ac:link": _link, "ac:image": _image, "ac:task-list": _tasks, "ac:plain-text-body": lambda n, d: n.text(),
    **{f"h{k}": _heading(k) for k in range(1, 7)}, **{t: _marked("**") for t in BOLD}, **{t: _marked("*") for t in ITALIC}, **{t: _marked("~~") for t in STRUCK},
    **{t: (lambda n, d: "") for t in SILENT},
}


def normalize_pages(pages: DataFrame, source: str = "storage_html", target: str = "markdown") -> DataFrame:
    """All columns of ``pages`` but the source, with ``target`` and ``error``."""
    from pyspark.sql.types import StringType, StructType

    kept = [c for c in pages.columns if c not in (source, target, "error")]
    schema = StructType([*pages.select(*kept).schema.fields]).add(target, StringType()).add("error", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, error = [], []
            for s in b.column(len(kept)):
                try:
                    text.append(to_markdown(s.as_py()))
                    error.append(None)
                except Exception as e:  # one page's failure is a row, not the end of the job
                    text.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(text, pa.string()), pa.array(error, pa.string())], schema.fieldNames())

    return pages.select(*kept, F.col(source)).mapInArrow(run, schema)
