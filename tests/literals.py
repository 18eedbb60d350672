"""Small inputs with their outputs, for rules that the driver's tables don't touch: wiki markup and Markdown structure.

Outputs were worked out by hand from the rules.
"""

from __future__ import annotations

_M = '<ac:structured-macro ac:name="{}">{}</ac:structured-macro>'
_TITLE = '<ac:parameter ac:name="title">{}</ac:parameter>'
_RICH = "<ac:rich-text-body>{}</ac:rich-text-body>"
_PLAIN = "<ac:plain-text-body><![CDATA[{}]]></ac:plain-text-body>"
_TASK = "<ac:task><ac:task-status>{}</ac:task-status><ac:task-body>{}</ac:task-body></ac:task>"

#: name, storage markup, Markdown
MARKUP: list[tuple[str, str, str]] = [
    ("blank", "  \n ", ""),
    ("heading", "<h2>Title</h2><p>Some <b>bold</b> and <em>soft</em> and <del>old</del> text</p>", "## Title\n\nSome **bold** and *soft* and ~~old~~ text\n"),
    ("spaces", "<p>a \t  b&#160;c</p>", "a b c\n"),
    ("break", "<p>one<br/>two</p><hr/><p>x</p>", "one two\n\n---\n\nx\n"),
    ("silent", "<p>a</p><script>x()</script><style>y</style><!-- z --><span>b</span>", "a\n\nb\n"),
    ("links", '<p><a href="https://example.test/x">here</a> <a href="#top">top</a> <a href="/y"></a></p>', "[here](https://example.test/x) top /y\n"),
    ("inline_code", "<p>run <code>kubectl  get</code></p>", "run `kubectl get`\n"),
    ("pre", '<pre class="language-x"><code class="hl language-sh">a\n b</code></pre>', "```sh\na\n b\n```\n"),
    ("long_fence", "<pre>a\n```\nb</pre>", "````\na\n```\nb\n````\n"),
    ("quote", "<blockquote><p>a</p><p>b</p></blockquote>", "> a\n>\n> b\n"),
    ("list", "<ol><li>a<ul><li>b</li><li>c</li></ul></li><li>d</li></ol>", "1. a\n    - b\n    - c\n2. d\n"),
    ("list_code", "<ol><li>a<pre>x</pre></li></ol>", "1. a\n   ```\n   x\n   ```\n"),
    ("table", "<table><tr><th>A</th><th>B</th></tr><tr><td>1|2</td></tr><tr><td> </td></tr></table>", "| A | B |\n| --- | --- |\n| 1\\|2 |  |\n"),
    ("table_plain", "<table><tr><td>1</td></tr></table>", "|  |\n| --- |\n| 1 |\n"),
    ("table_late_header", "<table><tr><td>1</td></tr><tr><th>H</th></tr></table>", "| H |\n| --- |\n| 1 |\n"),
    ("code", _M.format("code", '<ac:parameter ac:name="language">bash</ac:parameter>' + _PLAIN.format("a && b > c")), "```bash\na && b > c\n```\n"),
    ("noformat", _M.format("noformat", _PLAIN.format("raw")), "```\nraw\n```\n"),
    ("panel", _M.format("warning", _RICH.format("<p>Careful</p><p>now</p>")), "> **WARNING**\n>\n> Careful\n>\n> now\n"),
    ("panel_title", _M.format("info", _TITLE.format("Read") + _RICH.format("<p>This</p>")), "> **INFO: Read**\n>\n> This\n"),
    ("panel_empty", "<p>a</p>" + _M.format("info", _RICH.format("")), "a\n"),
    ("expand", _M.format("expand", _RICH.format("<p>In</p>")), "**Details**\n\nIn\n"),
    ("expand_empty", "<p>a</p>" + _M.format("expand", _TITLE.format("T") + _RICH.format(" ")), "a\n"),
    ("status", "<p>is " + _M.format("status", _TITLE.format("DONE")) + "</p>", "is `DONE`\n"),
    ("issue", "<p>" + _M.format("jiraissues", '<ac:parameter ac:name="key">AB-1</ac:parameter>') + " " + _M.format("jira", "") + "</p>", "[Jira AB-1] [Jira issue]\n"),
    ("skipped", '<ac:structured-macro ac:name="toc"/><p>Kept</p>', "Kept\n"),
    ("unknown", _M.format("odd", _RICH.format("<p>Prose</p>")), "Prose\n"),
    ("page_link", '<p><ac:link><ri:page ri:content-title="Other"/><ac:link-body>the page</ac:link-body></ac:link></p>', "the page (see: Other)\n"),
    ("file_link", '<p><ac:link><ri:page ri:content-title="P"/><ri:attachment ri:filename="f.txt"/></ac:link></p>', "f.txt\n"),
    ("image", '<ac:image><ri:attachment ri:filename="a.png"/></ac:image>', "[image: a.png]\n"),
    ("image_url", '<ac:image><ri:url ri:value="https://example.test/b.png"/></ac:image>', "[image: https://example.test/b.png]\n"),
    ("tasks", "<ac:task-list>" + _TASK.format("COMPLETE", "Done") + _TASK.format("incomplete", "Open") + _TASK.format("complete", "") + "</ac:task-list>", "- [x] Done\n- [ ] Open\n"),
    ("layout", "<ac:layout><ac:layout-section><ac:layout-cell><p>in</p></ac:layout-cell></ac:layout-section></ac:layout>", "in\n"),
]

_ECHO = [f"echo line {i}" for i in range(10)]
_ITEMS = [f"{i}. alpha beta" for i in range(10)]
_ROWS = [f"| {i} | x |" for i in range(6)]
_HEAD = "| a | b |\n| --- | --- |"
_SHORT = "a1 a2 a3 a4 a5 a6 a7 a8 a9 b1 b2 b3 b4 b5 b6 b7 b8 b9"
_CODE = "```sh\n{}\n```\n<!-- code block part {}/2 -->"

#: name, Markdown, largest and least size, overlap, chunks: (section, chunk, path, kind, body). The page's title is Page.
STRUCTURE: list[tuple[str, str, int, int, int, list[tuple[int, int, str, str, str]]]] = [
    ("sections", "Intro\n\n## Symptoms\n\nClients wait.\n\n```sh\n# not a heading\n```\n\n## Diagnosis\n\n### Bananas\n\ntext", 100, 2, 0, [
        (0, 0, "Page", "other", "Intro"), (1, 0, "Symptoms", "symptoms", "Clients wait.\n\n```sh\n# not a heading\n```"), (3, 0, "Diagnosis > Bananas", "diagnosis", "text"),
    ]),
    ("own_title", "# Page\n\ntop\n\n## A\n\nin", 100, 2, 0, [(1, 0, "Page", "other", "top"), (2, 0, "A", "other", "in")]),
    ("code", "```sh\n" + "\n".join(_ECHO) + "\n```", 30, 2, 0, [(0, i, "Page", "other", _CODE.format("\n".join(_ECHO[5 * i : 5 * i + 5]), i + 1)) for i in range(2)]),
    ("list", "\n".join(_ITEMS), 20, 2, 0, [(0, i, "Page", "other", "\n".join(x) + f"\n\n(continued — step list part {i + 1}/2)") for i, x in enumerate((_ITEMS[:6], _ITEMS[6:]))]),
    ("table", _HEAD + "\n" + "\n".join(_ROWS), 30, 2, 0, [(0, i, "Page", "other", _HEAD + "\n" + "\n".join(x)) for i, x in enumerate((_ROWS[:4], _ROWS[4:]))]),
    ("prose", "Alpha beta gamma. A1 a2 a3 a4 a5 a6 a7 a8 a9 b1 b2 b3 b4. End here now.", 10, 2, 0, [
        (0, 0, "Page", "other", "Alpha beta gamma."), (0, 1, "Page", "other", "A1 a2 a3 a4 a5 a6 a7 a8 a9 b1"), (0, 2, "Page", "other", "b2 b3 b4. End here now."),
    ]),
    ("merge", _SHORT + "\n\ntiny tail here", 20, 5, 0, [(0, 0, "Page", "other", _SHORT + "\n\ntiny tail here")]),
    ("overlap", "First one here. Second one there.\n\nThird thing comes now.", 10, 2, 5, [(0, 0, "Page", "other", "First one here. Second one there."), (0, 1, "Page", "other", "Second one there.\n\nThird thing comes now.")]),
    ("quote", "> a\n\n> b\n\nafter", 100, 2, 0, [(0, 0, "Page", "other", "> a\n\n> b\n\nafter")]),
    ("empty", "## Only a heading", 100, 2, 0, []),
]
