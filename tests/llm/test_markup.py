import pytest
from hypothesis import given, settings, strategies as st

from textloom.llm import markup

FOUND = {
    "<p>Hi</p>": ["html"], "a &mdash; b": ["html"], "&lt;p&gt;x&lt;/p&gt;": ["html"], "x <br /> y": ["html"], "<!-- c -->": ["html"],
    "# Title\ntext": ["markdown"], "Title\n=====\n": ["markdown"], "see `code --fix` now": ["markdown"], "[a](http://x.y)": ["markdown"],
    "![a](b.png)": ["markdown"], "**bold** word": ["markdown"], "~~gone~~": ["markdown"], "```\n<p>x</p>\n```": ["markdown"],
    "== Head ==\n": ["wiki"], "a [[link|text]] b": ["wiki"], "''it'' and": ["wiki"], "{{cite|a|b}}": ["wiki"], "{| class\n! a\n|}": ["wiki"],
    "\\section{A}": ["latex"], "With $x_1 = 2$ done": ["latex"], "\\(a+b\\)": ["latex"], "\\begin{itemize}\n\\item a\n\\end{itemize}": ["latex"],
    "<p>x</p> and \\emph{y}": ["html", "latex"],
    "Keep df < 17 and tf > 2": [], "List<Posting> or Map<Term, X>": [], "5 * 8 * 2 bytes": [], "costs $5 a month, or $32": [],
    "About ~82% of x {all shards}": [], "C# uses x_1 and x^2": [], "C:\\new\\folder": [], "[sic] 1 & 2": [], "#3189 is open": [], "snake_case_name": [],
    "word\n----\nmore": [], "abc==": [], "": [],
}


@pytest.mark.parametrize(("text", "kinds"), FOUND.items())
def test_languages(text, kinds):
    assert markup.languages(text) == kinds


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab <>/p=#*_`~[](){}|'\\$&;!\n-1", max_size=120))
def test_never_fails(text):
    markup.clean(text)
    markup.slots_of(text, [["html:p", "html:/p"]])


def test_clean_keeps_structure():
    page = "<html><head><style>p{}</style></head><body><h1>Top</h1><p>A &amp; <b>b</b></p><ul><li>one<li>two</ul><pre>x = 1\n  y</pre></body></html>"
    assert markup.clean(page) == "Top\n\nA & b\n\n• one\n• two\n\n    x = 1\n      y"
    assert markup.clean("# Top\n\n- a **b**\n- [c](d)\n\n```py\nx\n```") == "Top\n\n• a b\n• c\n\n    x"
    assert markup.clean("== Top ==\n* [[a|b]]\n** ''c''") == "Top\n\n• b\n• c"
    assert markup.clean("\\section{Top}\n\\begin{itemize}\n\\item \\textbf{a \\emph{b}}\n\\end{itemize}\n$x_1 = 2$") == "Top\n\n• a b\n\nx_1 = 2"
    assert markup.clean("plain  text\n- stays") == "plain  text\n- stays"


def test_templates(spark):
    page = "<html><head><title>{0}</title></head><body><h1>{0}</h1><p>{1}</p></body></html>"
    rows = [(k, None, page.format(f"t{k}", f"b{k} <i>x</i>" if k == 1 else f"b{k}"), None, "c", "host/a.x", "clash") for k in range(4)]
    rows += [(9, "t", None, "", None, None, None), (None, None, "<p>", None, None, None, None), rows[0], (8, None, "<p>" * 100_000, None, "c", "o/x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, body string, text string, category string, path string, host string")
    pages = markup.fields(docs).distinct()
    classes = markup.equivalence_classes(markup.tokens(pages)).collect()
    assert [(c.host, c.pages) for c in classes] == [("host", 4)] and classes[0].tokens[0] == "html:html"
    out = {(r.doc_id, r.place.split(" ")[-1]): r.value for r in markup.slots(pages, markup.equivalence_classes(markup.tokens(pages))).collect()}
    assert out[2, "html:title"] == "t2" and out[2, "html:p"] == "b2" and out[1, "html:p"] == "b1 x"
    empty = markup.fields(docs.limit(0))
    assert markup.tokens(empty).count() == 0 and markup.cleaned(empty).count() == 0
    assert markup.equivalence_classes(markup.tokens(empty)).count() == 0
    assert {r.doc_id for r in markup.cleaned(pages).collect()} == {0, 1, 2, 3, 8}


@pytest.mark.parametrize(
    "sign", ["\\begin{verbatim}", "<pre>", "<!--", "```\nx\n", "\\(", "$ a=b", "\\emph{", "{{", "<code>", "<ref>", "= a  ", " ", "**a", "''a 'b", " |", "\\begin{align}"]
)
def test_unclosed_signs_take_linear_time(sign):
    import time

    text = sign * (131_072 // len(sign))
    began = time.process_time()
    markup.clean(text)
    assert time.process_time() - began < 2  # some 0.1 s; quadratic time would be minutes


def test_stretches_end_where_their_closer_is():
    assert markup.clean("a <pre>b\n<pre>c</pre> d </pre>") == "a\n\n    b\n    c\n\nd"
    assert markup.clean("```\na\n~~~\nb\n```\n# c") == "a\n~~~\nb".replace("\n", "\n    ").join(["    ", "\n\nc"])
    assert markup.languages("\\( a\n b \\)") == [] and markup.languages("\\( a \\) b \\)") == ["latex"]
    assert markup.languages("a $5 or $6 b") == [] and markup.languages("$5, $x_1$") == ["latex"]
    assert markup.clean("\\emph{a {b} c} {d}") == "a {b} c {d}"


def test_nested_templates_and_kinds(spark):
    row = "<tr><td>{0}</td></tr>"
    page = "<html><body><table>{0}</table></body></html>"
    rows = [(k, page.format("".join(row.format(f"v{k}{n}") for n in range(1 + k % 3))) + ("*x* _y_ `z`" if k == 5 else ""), "host/a.x") for k in range(6)]
    rows += [(7, "<b>x</b>", "host/b.x"), (8, "plain", "host/c.x")]
    docs = spark.createDataFrame(rows, "doc_id long, body string, path string").selectExpr("*", "null as category", "cast(null as string) as text")
    pages = markup.fields(docs)
    found = markup.tokens(pages)
    classes = markup.equivalence_classes(found)
    by = {tuple(c.tokens): (c.parent_id, c.gap, c.class_id) for c in classes.collect()}
    outer = ("html:html", "html:body", "html:table", "html:/table", "html:/body", "html:/html")
    inner = next(t for t in by if "html:tr" in t)
    assert set(by) == {outer, inner} and by[inner][:2] == (by[outer][2], 3) and by[outer][0] is None
    kinds = {(r.doc_id, r.kind, r.part) for r in markup.kinds(found, classes).collect()}
    assert kinds == {(k, "html", "template") for k in range(6)} | {(5, "markdown", "slot"), (7, "html", "slot")}
    slots = markup.slots(pages, classes).collect()
    assert {r.doc_id for r in slots} == set(range(6)) and {r.value for r in slots if r.doc_id == 1} == {"v10", "v11"}
    cleaned = {r.doc_id: r.clean for r in markup.cleaned(pages, classes).collect()}
    assert cleaned[1].split() == ["v10", "v11"] and cleaned[7] == "x" and cleaned[8] == "plain"
