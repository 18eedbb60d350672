import pytest

from runloom.operators import chunking as C
from runloom.operators.normalize import normalize_pages, to_markdown

RUNBOOK = """# Pool exhausted

Intro text.

## Symptoms

Clients wait. Errors rise.

## Diagnosis

```bash
# not a heading
psql -c 'select 1'
```

## Remediation

1. First step.
2. Second step.
3. Third step.
4. Fourth step.

## Escalation

Page the owner.
"""


def doc(text, title="Pool exhausted", page="p1"):
    return {"page_id": page, "title": title, "url": "u", "space_key": "S", "version": 1, "labels": ["x"], "markdown": text, "content_hash": "h"}


def cut(text, most=512, least=32, overlap=0, count=C.estimate, **k):
    return C.chunk_document(doc(text, **k), most, least, overlap, count)


def test_paths_and_kinds():
    out = cut(RUNBOOK)
    assert [(c["section_path"], c["section_kind"]) for c in out] == [
        (["Pool exhausted"], "other"), (["Symptoms"], "symptoms"), (["Diagnosis"], "diagnosis"), (["Remediation"], "remediation"), (["Escalation"], "escalation")
    ]
    assert cut("# Overview\n\n## Symptoms\n\ntext")[0]["section_path"] == ["Overview", "Symptoms"]
    assert cut("# A\n## B\n### C\ntext", title="A")[0]["section_path"] == ["B", "C"]
    assert cut("## Diagnosis\n### Bananas\ntext")[0]["section_kind"] == "diagnosis"


def test_procedure_whole_and_fences_balanced():
    out = cut(RUNBOOK)
    assert sum("1. First" in c["body_text"] and "4. Fourth" in c["body_text"] for c in out) == 1
    for most in (40, 60, 120):
        assert all(c["body_text"].count("```") % 2 == 0 for c in cut(RUNBOOK, most, 20))


def test_oversized_parts():
    steps = "## Steps\n\n" + "\n".join(f"{i}. Step number {i} is done like this." for i in range(39))
    out = cut(steps, 100, 20)
    assert len(out) > 1 and all(any(f"{i}. Step number {i} is done like this." in c["body_text"] for c in out) for i in range(39))
    assert all(f"\n\n(continued — step list part {i}/{len(out)})" in c["body_text"] for i, c in enumerate(out, 1))
    code = "```sh\n" + "\n".join(f"echo line {i}" for i in range(80)) + "\n```"
    out = cut(code, 100, 20)
    assert len(out) > 1 and all(c["body_text"].count("```") == 2 for c in out) and all(any(f"echo line {i}\n" in c["body_text"] for c in out) for i in range(80))
    open_ended = "```sh\n" + "\n".join(f"echo line {i}" for i in range(80))
    assert any("echo line 79" in c["body_text"] for c in cut(open_ended, 100, 20))
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | value {i} |" for i in range(60))
    out = cut(table, 100, 20)
    assert len(out) > 1 and all(c["body_text"].startswith("| a | b |\n| --- |") for c in out)
    prose = " ".join(f"Sentence {i} says a thing." for i in range(100))
    out = cut(prose, 60, 2)
    assert len(out) > 1 and " ".join(c["body_text"] for c in out) == prose


def test_a_quote_holds_its_blank_lines():
    assert C.blocks(["> a", "", "> b", "", "text"]) == [("quote", "> a\n\n> b"), ("paragraph", "text")]


def test_blocks_merge_overlap():
    kinds = [k for k, _ in C.blocks("para\n\n```\nx\n```\n\n| a |\n| - |\n\n- one\n- two\n\n- three\n> quote".split("\n"))]
    assert kinds == ["paragraph", "code", "table", "list", "quote"]
    out = cut(" ".join(f"Sentence {i} is here." for i in range(60)), 60, 10, 20)
    assert len(out) > 1 and out[1]["body_text"].split("\n\n")[0] in out[0]["body_text"]
    assert cut("") == [] and cut("## Only a heading") == []


def test_ids():
    a, b, c = cut(RUNBOOK), cut(RUNBOOK), cut(RUNBOOK, page="p2")
    ids = lambda x: [r["chunk_id"] for r in x]
    assert ids(a) == ids(b) and not set(ids(a)) & set(ids(c)) and len(set(ids(a))) == len(a)


def test_chunk_frames(spark):
    schema = "page_id string, title string, url string, space_key string, version int, labels array<string>, markdown string, content_hash string"
    d = spark.createDataFrame([tuple(doc(RUNBOOK).values()), tuple(doc(None, page="p2").values()), tuple(doc(RUNBOOK, title=None, page="p3").values())], schema)
    rows = C.chunk_documents(d, 512, 32, 0, "estimate").collect()
    assert sum(r.page_id == "p1" for r in rows) == 5 and not any(r.page_id == "p2" for r in rows)
    with pytest.raises(ValueError):
        C.chunk_documents(d, 10, 10)


@pytest.mark.parametrize("source,want", [
    ("<h2>Title</h2><p>Some <b>bold</b> text</p>", "## Title\n\nSome **bold** text\n"),
    ('<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">bash</ac:parameter><ac:plain-text-body><![CDATA[a && b > c]]></ac:plain-text-body></ac:structured-macro>', "```bash\na && b > c\n```\n"),
    ('<ac:structured-macro ac:name="noformat"><ac:plain-text-body><![CDATA[raw]]></ac:plain-text-body></ac:structured-macro>', "```\nraw\n```\n"),
    ('<ac:structured-macro ac:name="warning"><ac:rich-text-body><p>Careful</p></ac:rich-text-body></ac:structured-macro>', "> **WARNING**\n>\n> Careful\n"),
    ('<ac:structured-macro ac:name="info"><ac:parameter ac:name="title">Read</ac:parameter><ac:rich-text-body><p>This</p></ac:rich-text-body></ac:structured-macro>', "> **INFO: Read**\n>\n> This\n"),
    ('<ac:structured-macro ac:name="expand"><ac:rich-text-body><p>In</p></ac:rich-text-body></ac:structured-macro>', "**Details**\n\nIn\n"),
    ("<ol><li>a</li><li>b</li></ol>", "1. a\n2. b\n"), ("<ul><li>a<ul><li>b</li></ul></li></ul>", "- a\n    - b\n"),
    ("<table><tr><th>A</th><th>B</th></tr><tr><td>1|2</td><td></td></tr></table>", "| A | B |\n| --- | --- |\n| 1\\|2 |  |\n"),
    ("<table><tr><td>1</td></tr></table>", "|  |\n| --- |\n| 1 |\n"),
    ("<ac:task-list><ac:task><ac:task-status>complete</ac:task-status><ac:task-body>Done</ac:task-body></ac:task><ac:task><ac:task-status>incomplete</ac:task-status><ac:task-body>Open</ac:task-body></ac:task></ac:task-list>", "- [x] Done\n- [ ] Open\n"),
    ('<p>See <a href="https://example.test/x">here</a> and <code>kubectl get</code></p>', "See [here](https://example.test/x) and `kubectl get`\n"),
    ('<ac:structured-macro ac:name="toc"/><p>Kept</p>', "Kept\n"), ('<ac:structured-macro ac:name="odd"><ac:rich-text-body><p>Prose</p></ac:rich-text-body></ac:structured-macro>', "Prose\n"),
    ('<ac:link><ri:page ri:content-title="Other"/></ac:link>', "Other\n"), ('<ac:image><ri:attachment ri:filename="a.png"/></ac:image>', "[image: a.png]\n"),
    ('<ac:structured-macro ac:name="jira"><ac:parameter ac:name="key">AB-1</ac:parameter></ac:structured-macro>', "[Jira AB-1]\n"), ("", ""), (None, ""), ("  ", ""),
    ('<ac:structured-macro ac:name="code"><ac:plain-text-body><![CDATA[a\n```\nb]]></ac:plain-text-body></ac:structured-macro>', "````\na\n```\nb\n````\n"),
])
def test_normalize(source, want):
    assert to_markdown(source) == want


def test_normalize_frames(spark):
    d = spark.createDataFrame([(1, "<p>x</p>"), (2, None)], "page_id long, storage_html string")
    assert [tuple(r) for r in normalize_pages(d).orderBy("page_id").collect()] == [(1, "x\n", None), (2, "", None)]
