"""Markup of four languages: signs, clean text."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.plans.session import written

# Names of HTML elements.
ELEMENTS = (
    "a abbr address article aside b big blockquote body br button caption center cite code col dd del dfn div dl dt em "
    "figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link "
    "main mark meta nav noscript ol option p pre q s samp script section select small span strike strong style sub "
    "summary sup table tbody td textarea tfoot th thead title tr tt u ul var video"
).split()
# Names of LaTeX commands that are taken for markup without an argument, and environments.
COMMANDS = (
    "item par noindent newline newpage clearpage maketitle tableofcontents centering hline toprule midrule bottomrule "
    "LaTeX TeX ldots dots quad qquad today appendix bigskip medskip smallskip"
).split()
_NAMES = "|".join(sorted(ELEMENTS, key=len, reverse=True))
_TAG = rf"</?(?:{_NAMES})(?:\s[^<>]*|\s*/)?>"
#: What a formula between dollar signs must hold, if it isn't one letter.
_MATH = re.compile(r"\\[A-Za-z]+|[\^_]|[A-Za-z0-9)}\]]\s*[=<>+*/]\s*\S|\\\\")
_MATHS = "equation|align|gather|displaymath|math|eqnarray"

#: Stretches that no other rule looks into, tried first at each place: what opens one, what closes it,
#: and whether both must stand on one line. A closer's name (or fence) must be the opener's, if it has one.
_STRETCHES = [
    ("html", "drop", r"<(?:script|style)\b[^<>]*>", r"</(?:script|style)\s*>", False),
    ("html", "comment", r"<!--", r"-->", False),
    ("html", "code", r"<pre\b[^<>]*>", r"</pre\s*>", False),
    ("html", "inline_code", r"<code\b[^<>]*>", r"</code\s*>", True),
    ("wiki", "code", r"<(?:nowiki|syntaxhighlight|source)\b[^<>]*(?<!/)>", r"</(?:nowiki|syntaxhighlight|source)\s*>", False),
    ("wiki", "drop", r"<ref\b[^<>]*(?<!/)>", r"</ref\s*>", False),
    ("latex", "code", r"\\begin\{(?:verbatim|lstlisting|minted)\*?\}", r"\\end\{(?:verbatim|lstlisting|minted)\*?\}", False),
    ("latex", "formula", rf"\\begin\{{(?:{_MATHS})\*?\}}", rf"\\end\{{(?:{_MATHS})\*?\}}", False),
    ("latex", "formula", r"\\\[", r"\\\]", False),
    ("latex", "inline_formula", r"\\\(", r"\\\)", True),
    ("markdown", "code", r"^(?:```+|~~~+)[^\n`]*\n", r"^(?P<fence>```+|~~~+)[ \t]*$", False),
]
#: All other signs.
_RULES = [
    ("html", "doctype", r"<!DOCTYPE\b[^<>]*>|<\?xml\b[^<>]*\?>"),
    ("html", "cell", r"<t[dh]\b[^<>]*>"),
    ("wiki", "drop", r"<ref\b[^<>]*/>|<references\s*/?>"),
    ("latex", "formula", r"\$\$[^$]+\$\$"),
    ("latex", "inline_formula", r"(?<![\\$\w])\$(?=\S)[^$\n]+(?<=\S)\$(?![\d$])"),
    ("markdown", "inline_code", r"(?<![`\\\w])`[^`\n]+`(?![`\w])"),
    ("latex", "heading", r"\\(?:part|chapter|(?:sub)*section|paragraph)\*?\{[^{}\n]*(?:\{[^{}\n]*\}[^{}\n]*)*\}"),
    ("latex", "title", r"\\title\{[^{}\n]*\}"),
    ("latex", "drop", r"\\(?:documentclass|usepackage|bibliographystyle|bibliography|pagestyle|input|include)(?:\[[^\]\n]*\])?\{[^{}\n]*\}|~?\\(?:cite[pt]?|label|ref|eqref|pageref|index|vspace|hspace)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}"),
    ("latex", "environment", r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?(?:\{[|lcrp@{}. 0-9]*\})?"),
    ("latex", "item", r"\\item\b(?:\[[^\]\n]*\])?[ \t]*"),
    ("latex", "style", r"\\(?:emph|text(?:bf|it|tt|sc|rm|sf|up|sl)|underline|footnote|mbox|url|href|caption|author|date)\*?\{"),
    ("latex", "command", r"(?<![\w:\\])\\(?:" + "|".join(COMMANDS) + r")(?![A-Za-z\\])"),
    ("latex", "escape", r"\\[%&_#{}](?!\w*\\)"),
    ("wiki", "heading", r"^(?P<wikih>={1,6})[ \t]*[^=\s][^\n]*(?P=wikih)[ \t]*$|^(?P<wikis>={1,6})[^=\s](?P=wikis)[ \t]*$"),
    ("wiki", "table", r"^\{\|[^\n]*$|^\|\}[ \t]*$|^\|-[^\n]*$|^\|\+[^\n]*$"),
    ("wiki", "template", r"\{\{(?:[^{}]|\{\{[^{}]*\}\})*\}\}"),
    ("wiki", "category", r"\[\[(?:Category|File|Image|Datei|Kategorie|Fichier|Catégorie|Archivo|Categoría):[^\[\]\n]*\]\]"),
    ("wiki", "link", r"\[\[[^\[\]\n]+\]\]"),
    ("wiki", "external", r"\[https?://[^\s\]]+(?:[ \t][^\]\n]*)?\](?!\()"),
    ("wiki", "style", r"(?<!')'{2,3}(?=[^'\s])[^'\n]+(?:'[^'\n]+)*'{2,3}(?!')|(?<!')'{5}[^'\n]+'{5}(?!')"),
    ("wiki", "magic", r"__(?:NO)?(?:TOC|EDITSECTION|FORCETOC|INDEX)__|~~~~~?(?=\s|$)"),
    ("wiki", "redirect", r"^\#REDIRECT\b"),
    ("html", "tag", rf"(?<![\w]){_TAG}|(?<=\w)(?:</(?:{_NAMES})\s*>|<(?:br|hr|{_NAMES})(?:\s[^<>]*|\s*/)>|<(?:br|hr|p|div|li|ul|ol|em|strong|span|code|sub|sup|td|tr|h[1-6])>)"),
    ("html", "entity", r"&(?:#\d{1,6}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,12}\d{0,2});"),
    ("markdown", "image", r"!\[[^\]\n]*\]\([^()\n]*\)"),
    ("markdown", "link", r"(?<!\\)\[[^\[\]\n]+\]\([^()\s]*(?:[ \t]+\"[^\"\n]*\")?\)|(?<!\\)\[[^\[\]\n]+\]\[[^\[\]\n]*\]|<https?://[^\s<>]+>"),
    ("markdown", "reference", r"^[ \t]{0,3}\[[^\]\n]+\]:[ \t]+\S+[^\n]*$"),
    ("markdown", "heading", r"^[ ]{0,3}\#{1,6}[ \t]+[^\s#][^\n]*$|^[^\s|>#=\-][^\n]*\n(?:={3,}|-{5,})[ \t]*$"),
    ("markdown", "table", r"^(?:[ \t]*\|)?(?:[ \t]*:?-{3,}:?[ \t]*\|)+(?:[ \t]*:?-{3,}:?)?[ \t]*$"),
    ("markdown", "task", r"^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]"),
    ("markdown", "style", r"(?<![\w*\\])\*\*(?=\S)[^*\n]+(?<=\S)\*\*(?![\w*])|(?<![\w_\\])__(?=[^\s_])[^_\n]+(?<=[^\s_])__(?![\w_])|(?<![\w*\\])\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])[^_\n]+(?<=[^\s_])_(?![\w_])|(?<![\w~])~~(?=[^\s~])[^~\n]+(?<=[^\s~])~~(?![\w~])"),
]

_STARTS = r"[<&\\$`~#=\[{'!_*|^]"
#: Rules that begin at the start of a line with any sign.
_AT_LINE = [k for k, (_, _, pattern) in enumerate(_RULES) if "^" in re.sub(r"\[\^|\\\^", "", pattern)]


@lru_cache(maxsize=2)
def _lexer(stretches: bool) -> re.Pattern[str]:
    """All rules in one expression; places that can't begin a sign are passed by at once."""
    opening = [f"(?P<s{k}>{opener})" for k, (_, _, opener, *_) in enumerate(_STRETCHES) if stretches]
    named = [f"(?P<r{k}>{pattern})" for k, (_, _, pattern) in enumerate(_RULES)]
    inline = "|".join(x for k, x in enumerate(named) if k not in _AT_LINE)
    lines = "|".join(named[k] for k in _AT_LINE)
    first = rf"(?={_STARTS})(?:{'|'.join(opening)})|" if opening else ""
    return re.compile(rf"{first}(?=^)(?:{lines})|(?={_STARTS})(?:{inline})", re.M | re.S | re.I)


@lru_cache(maxsize=1)
def _closers() -> list[re.Pattern[str]]:
    return [re.compile(closer, re.M | re.I) for *_, closer, _ in _STRETCHES]


class _Ends:
    """Where stretches of one text end. Closers are listed once for each kind, so however many
    openers stay unclosed, the text is read once for each kind."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.known: dict[tuple[int, str], tuple[list[int], list[int]]] = {}
        self.listed: set[int] = set()
        self.breaks: list[int] | None = None

    def after(self, kind: int, fence: str, start: int, one_line: bool) -> int:
        """End of the first closer from ``start`` on, or -1."""
        if kind not in self.listed:
            self.listed.add(kind)
            for m in _closers()[kind].finditer(self.text):
                starts, ends = self.known.setdefault((kind, m[m.lastgroup] if m.lastgroup else ""), ([], []))
                starts.append(m.start())
                ends.append(m.end())
        starts, ends = self.known.get((kind, fence), ([], []))
        k = bisect_left(starts, start)
        if k == len(starts):
            return -1
        if one_line:
            if self.breaks is None:
                self.breaks = [m.start() for m in re.finditer("\n", self.text)]
            b = bisect_left(self.breaks, start)
            if b < len(self.breaks) and self.breaks[b] < starts[k]:
                return -1
        return ends[k]


def _fence(opener: str) -> str:
    return opener[: len(opener) - len(opener.lstrip(opener[0]))] if opener[0] in "`~" else ""


def signs(text: str) -> Iterator[tuple[str, str, int, int]]:
    """``(language, kind, start, end)`` of the markup signs of a text, in order. What stands in
    code of one language isn't looked into; entities must be known by name. Takes time in
    proportion to the text's length, whatever is left unclosed in it."""
    whole, plain = _lexer(True), _lexer(False)
    ends, at = _Ends(text), 0
    while m := whole.search(text, at):
        group = m.lastgroup or ""
        if group.startswith("s"):
            k = int(group[1:])
            language, kind, _, _, one_line = _STRETCHES[k]
            end = ends.after(k, _fence(m[0]), m.end(), one_line)
            if end >= 0:
                yield language, kind, m.start(), end
                at = end
                continue
            m = plain.match(text, m.start()) or m  # unclosed: what else begins here
            group = m.lastgroup or ""
            if group.startswith("s"):
                at = m.start() + 1
                continue
        group = next(g for g, x in m.groupdict().items() if x is not None and g[0] == "r") if group[0] != "r" else group
        language, kind, _ = _RULES[int(group[1:])]
        at = m.end()
        if kind == "entity" and html.unescape(m[0]) == m[0]:
            continue
        if kind == "inline_formula" and not (m.end() - m.start() == 3 and m[0][1].isascii() and m[0][1].isalpha()) and not _MATH.search(m[0], 1, len(m[0]) - 1):
            at = m.start() + 1  # two prices, say; the second sign may begin a formula
            continue
        yield language, kind, m.start(), m.end()


def languages(text: str | None) -> list[str]:
    """Languages of markup of which the text holds a sign."""
    return sorted({language for language, *_ in signs(text)}) if text else []


_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|center|div|dl|dt|dd|fieldset|figure|footer|form|head|header|hr|html|main|nav|ol|p|section|table|tr|ul|br)\b", re.I)
_ATTRIBUTES = re.compile(r"<[^<>]*>")
_WIKI_QUOTES = re.compile(r"'{2,5}")
_MARKDOWN_EDGES = re.compile(r"^(\*\*|__|~~|\*|_)(.*)\1$", re.S)
_ENVIRONMENT = re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?")


def _argument(sign: str) -> str:
    return sign[sign.index("{") + 1 : sign.rindex("}")]


def _indented(code: str) -> str:
    return "\n\n" + "\n".join("    " + line for line in code.strip("\n").split("\n")) + "\n\n"


def _replaced(language: str, kind: str, sign: str) -> str:
    """What a sign leaves in the clean text."""
    if kind in ("drop", "comment", "doctype", "magic", "redirect", "category", "reference"):
        return ""
    if kind == "code":
        if language == "markdown":
            return _indented("\n".join(sign.strip().split("\n")[1:-1]))
        body = _ENVIRONMENT.sub("", sign) if language == "latex" else html.unescape(_ATTRIBUTES.sub("", sign))
        return _indented(body)
    if kind == "inline_code":
        return html.unescape(_ATTRIBUTES.sub("", sign)) if language == "html" else sign.strip("`")
    if kind == "formula":
        return "\n\n" + _ENVIRONMENT.sub("", sign).replace("\\[", "").replace("\\]", "").strip("$ \n") + "\n\n"
    if kind == "inline_formula":
        return sign[2:-2].strip() if sign.startswith("\\(") else sign.strip("$")
    if kind in ("heading", "title"):
        if language == "latex":
            title = _argument(sign)
        elif language == "wiki":
            title = sign.strip().strip("=")
        else:
            title = sign.split("\n")[0].strip().strip("#")
        return f"\n\n{clean(title.strip())}\n\n"
    if kind == "environment":
        return "\n"
    if kind in ("item", "task"):
        return "\n• "
    if language == "latex" and kind == "style":
        return "\x02"  # its closing brace goes, too
    if kind == "command":
        return sign
    if kind == "escape":
        return sign[1:]
    if kind == "table":
        return ""
    if kind == "template":
        parts = [x.strip() for x in sign[2:-2].split("|")]
        return ", ".join(x for x in parts[1:] if x)
    if kind == "link" and language == "wiki":
        return sign[2:-2].rpartition("|")[2]
    if kind == "external":
        return sign[1:-1].partition(" ")[2] or sign[1:-1]
    if kind == "style" and language == "wiki":
        return _WIKI_QUOTES.sub("", sign)
    if kind in ("image", "link"):
        if sign.startswith("<"):
            return sign[1:-1]
        return clean(sign[sign.index("[") + 1 : sign.index("]")])
    if kind == "style":
        m = _MARKDOWN_EDGES.match(sign)
        return clean(m[2]) if m else sign
    if kind == "entity":
        return html.unescape(sign).replace("\xa0", " ")
    if kind == "cell":
        return " "
    tag = sign.lower()
    if re.match(r"</?(?:h[1-6]|title|caption)\b", tag):
        return "\n\n"
    if tag.startswith("<li"):
        return "\n• "
    if tag.startswith("</li"):
        return "\n"
    return "\n" if _BLOCK.match(tag) else ""


_BULLET = re.compile(r"^[ \t]*(?:[-*+]|\d+[.)])[ \t]+(?=\S|\Z)", re.M)
_WIKI_BULLET = re.compile(r"^[*#:;]+[ \t]*(?=\S|\Z)", re.M)


def clean(text: str, template: list[list[str]] | None = None) -> str:
    """The text without the signs of its markup. Headings stand in a paragraph of their own,
    list items begin with a bullet, code is indented by four spaces, formulas stay as they are
    written, without delimiters; texts without a sign come back unchanged. Escaped markup
    that becomes visible when entities are read is cleaned as well. With the classes of a
    ``template`` each slot between its tokens is cleaned as a text of its own line, so that
    what a slot leaves open ends with it."""
    found = list(signs(text))
    if not found:
        return text
    member = {t for names in template or () for t in names}
    seen = {language for language, *_ in found}
    parts: list[list[str]] = [[]]  # one part for each slot
    at, escaped = 0, False
    for language, kind, start, end in found:
        left = _replaced(language, kind, text[start:end])
        parts[-1].append(_text(text, at, start, seen))
        if member and name(text[start:end], language, kind) in member and left != "\x02":
            parts += [[left], []]
        else:
            parts[-1].append(left)
        escaped |= kind == "entity" and left == "<"
        at = end
    parts[-1].append(_text(text, at, len(text), seen))
    raw = "".join(_unbraced(x) if "\x02" in x else x for x in map("".join, parts))
    lines = [line.rstrip() if line.startswith("    ") else line.strip() for line in raw.split("\n")]
    if escaped:
        lines = [line if line.startswith("    ") else _ESCAPED.sub("", line) for line in lines]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


_ESCAPED = re.compile(_TAG, re.I)
_BRACES = re.compile("[\x02{}]")


def _unbraced(raw: str) -> str:
    """A text without the marks of style commands and the braces that close them."""
    out: list[str] = []
    at, open_ = 0, []
    for m in _BRACES.finditer(raw):
        closes = m[0] == "}" and open_ and open_.pop() == "\x02"
        if m[0] != "}":
            open_.append(m[0])
        out.append(raw[at : m.start()] if closes or m[0] == "\x02" else raw[at : m.end()])
        at = m.end()
    return "".join([*out, raw[at:]])


_ROW = re.compile(r"^[ \t]*\|(.*)$", re.M)


def _text(text: str, start: int, end: int, seen: set[str]) -> str:
    """Text between signs: bullets of the languages seen, quotation marks, cells, headers."""
    stretch = text[start:end]
    if not stretch:
        return stretch
    if start and text[start - 1] != "\n":  # its beginning isn't the beginning of a line
        return _text("\x03" + stretch, 0, len(stretch) + 1, seen).replace("\x03", "", 1)
    if "markdown" in seen or "wiki" in seen:
        if "wiki" in seen:
            stretch = re.sub(r"^[|!](?![-}|+])[ \t]*", "", stretch, flags=re.M)
            stretch = re.sub(r"(?<![ \t])[ \t]*(?:\|\||!!)[ \t]*", " | ", stretch)
            stretch = re.sub(r"^-{4,}[ \t]*$", "", stretch, flags=re.M)
            stretch = _WIKI_BULLET.sub("• ", stretch)
        stretch = _BULLET.sub("• ", stretch)
        if "markdown" in seen:
            stretch = _ROW.sub(lambda m: m[1].rstrip(" \t").removesuffix("|"), stretch)
            stretch = re.sub(r"^>[ \t]?", "", stretch, flags=re.M)
            stretch = re.sub(r"^(?:-{3,}|\*{3,}|_{3,})[ \t]*$", "", stretch, flags=re.M)
    return stretch


# Template deduction --------------------------------------------------------------------

_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)|<!(DOCTYPE)|\\(begin|end)\{(\w+)|\\([A-Za-z]+)", re.I)


def name(sign: str, language: str, kind: str) -> str:
    """A sign without attributes and content: what pages made from one template share."""
    m = _NAME.match(sign)
    if not m:
        return f"{language}:{kind}"
    close = "/" if sign.startswith("</") else ""
    return f"{language}:{close}{':'.join(x.lower() for x in m.groups() if x)}"


TOKENS = "doc_id long, field string, host string, language string, token string, n int, at array<int>"
_TOKENS = pa.schema(
    [
        ("doc_id", pa.int64()), ("field", pa.string()), ("host", pa.string()), ("language", pa.string()),
        ("token", pa.string()), ("n", pa.int32()), ("at", pa.list_(pa.int32())),
    ]
)


def _lex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for i, field, host, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            places: dict[tuple[str, str], list[int]] = {}
            for language, kind, start, end in signs(text):
                places.setdefault((language, name(text[start:end], language, kind)), []).append(start)
            out += [(i, field, host, a, b, len(at), at) for (a, b), at in places.items()]
        if out:
            columns = [pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _TOKENS, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=_TOKENS)


def fields(docs: DataFrame, names: tuple[str, ...] = ("body", "text")) -> DataFrame:
    """``doc_id, field, host, value`` of each filled field; ``host`` is the first part of the
    path, or the category where there is none. Null and empty fields and null ids have no row;
    repeated rows count once."""
    host = F.coalesce(F.split("path", "/")[0], F.col("category"), F.lit(""))
    each = [F.struct(F.lit(x).alias("field"), F.col(x).alias("value")) for x in names]
    return (
        docs.where("doc_id is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), host.alias("host"), F.explode(F.array(*each)).alias("x"))
        .select("doc_id", "x.field", "host", "x.value")
        .where("value is not null and value <> ''")
    )


def tokens(pages: DataFrame) -> DataFrame:
    """Distinct markup tokens of each field with their number and first place; texts that have
    none of the characters that begin a sign are passed by in the JVM."""
    begun = pages.where(F.col("value").rlike("[<&\\\\$`~#=\\[{'!_*|^]|(?m)^-{5,}|-{3,}[ \\t]*\\|"))
    return begun.select("doc_id", "field", "host", "value").mapInArrow(_lex, TOKENS)


#: Buckets that the tokens of one host are dealt out to, as one host may hold most pages.
HOST_BUCKETS = 16
_PAGE = ["host", "doc_id", "field"]


def _members(found: DataFrame, least_pages: int, least_tokens: int) -> DataFrame:
    """``host, token, class_id, pages`` of tokens with equal occurrence vectors, once for each bucket."""
    page = F.xxhash64("doc_id", "field", "n")
    vectors = (
        found.groupBy("host", "token")
        .agg(
            F.count("*").alias("pages"), F.sum("n").alias("total"), F.bit_xor(page).alias("v1"),
            F.sum(F.pmod(page, F.lit(1_000_000_007))).alias("v2"),
        )
        .where(F.col("pages") >= least_pages)
    )
    vector = ["host", "pages", "total", "v1", "v2"]
    large = vectors.groupBy(*vector).agg(F.count("*").alias("size"), F.min("token").alias("class_id")).where(
        F.col("size") >= least_tokens
    )
    return vectors.join(large.hint("merge"), vector).select("host", "token", "class_id", "pages")


def _dealt(found: DataFrame) -> DataFrame:
    return found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "field"), F.lit(HOST_BUCKETS)).cast("int"))


def _to_all(members: DataFrame) -> DataFrame:
    return members.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(HOST_BUCKETS - 1))))


def _on_pages(found: DataFrame, members: DataFrame) -> DataFrame:
    """``host, doc_id, field, class_id, pages, n, places, names`` of each class on each of its pages:
    all its tokens there in order."""
    placed = F.transform("at", lambda x: F.struct(x.alias("at"), F.col("token").alias("token")))
    return (
        _dealt(found).join(_to_all(members).hint("merge"), ["host", "token", "bucket"])
        .groupBy(*_PAGE, "class_id", "pages")
        .agg(F.sort_array(F.flatten(F.collect_list(placed))).alias("all"), F.first("n").alias("n"))
        .select(*_PAGE, "class_id", "pages", "n", F.col("all.at").alias("places"), F.col("all.token").alias("names"))
    )


def equivalence_classes(found: DataFrame, least_pages: int = 3, least_tokens: int = 3) -> DataFrame:
    """``host, class_id, tokens, pages, parent_id, gap``: the template that pages of a host share.

    A token's occurrence vector is its number on each page of the host; tokens with one vector
    (told by two hashes that don't depend on order, and its sums) form a class. A class is valid
    if it has ``least_tokens`` tokens on ``least_pages`` pages and is ordered: its tokens follow
    each other in the same order on every page, again and again where it comes repeatedly;
    ``tokens`` is in that order. Valid classes are nested: a class lies in another if on each of
    its pages all of it stands in the same gap of the other, not before or behind it;
    ``parent_id`` is the innermost of these and ``gap`` the number of its tokens before the gap.
    Tokens are names of signs, so a page has few classes, and no group that is gathered grows
    with the number of pages.
    """
    found = found.distinct()
    on_pages = written(_on_pages(found, _members(found, least_pages, least_tokens)))
    once = F.slice("names", F.lit(1), (F.size("names") / F.col("n")).cast("int"))
    valid = (
        on_pages.withColumn("tokens", once)
        .groupBy("host", "class_id", "pages")
        .agg(
            F.min("tokens").alias("tokens"), F.max("tokens").alias("other"),
            F.bool_and(F.flatten(F.array_repeat("tokens", F.col("n"))) == F.col("names")).alias("ordered"),
        )
        .where((F.col("tokens") == F.col("other")) & F.col("ordered"))
        .select("host", "class_id", "tokens", "pages")
    )
    size = F.size("tokens").alias("size")
    kept = _dealt(on_pages).join(_to_all(valid.select("host", "class_id", size)).hint("merge"), ["host", "class_id", "bucket"])
    inner = kept.select(*_PAGE, "class_id", "pages", "places")
    outer = kept.select(*_PAGE, F.col("class_id").alias("parent_id"), F.col("places").alias("around"), "size")
    before = F.transform("places", lambda x: F.size(F.filter("around", lambda y: y < x)))
    gaps = F.transform(before, lambda k: F.when(k < F.size("around"), k % F.col("size")).otherwise(F.lit(0)))
    parents = (
        inner.join(outer.hint("merge"), _PAGE).where("class_id <> parent_id").withColumn("gaps", F.array_distinct(gaps))
        .where((F.size("gaps") == 1) & (F.col("gaps")[0] > 0))
        .groupBy("host", "class_id", "parent_id", "pages")
        .agg(
            F.count("*").alias("on"), F.min(F.col("gaps")[0]).alias("gap"), F.max(F.col("gaps")[0]).alias("other"),
            F.sum(F.array_max(F.filter("around", lambda y: y < F.col("places")[0])).cast("long")).alias("near"),
        )
        .where((F.col("on") == F.col("pages")) & (F.col("gap") == F.col("other")))
        .groupBy("host", "class_id")
        .agg(F.max(F.struct("near", "parent_id", "gap")).alias("p"))
        .select("host", "class_id", "p.parent_id", "p.gap")
    )
    return valid.join(parents.hint("merge"), ["host", "class_id"], "left")


def template_tokens(classes: DataFrame) -> DataFrame:
    """``host, token, class_id`` of every token of a template."""
    return classes.select("host", "class_id", F.explode("tokens").alias("token"))


def page_templates(found: DataFrame, classes: DataFrame) -> DataFrame:
    """``doc_id, field, classes``: the token lists of the classes that each page was made from."""
    one = classes.select("host", "class_id", "tokens", F.col("tokens")[0].alias("token"))
    on = _dealt(found).join(_to_all(one).hint("merge"), ["host", "token", "bucket"])
    return on.groupBy("doc_id", "field").agg(F.collect_set("tokens").alias("classes"))


def kinds(found: DataFrame, classes: DataFrame) -> DataFrame:
    """``doc_id, field, kind, part``: languages of markup of each field, from the template that its
    page was made from ('template') and from the signs in the slots that remain ('slot'); a page
    without a template is one slot."""
    member = template_tokens(classes)
    on_template = page_templates(found, classes).select("doc_id", "field", F.explode(F.flatten("classes")).alias("token"))
    remaining = _dealt(found).join(_to_all(member).hint("merge"), ["host", "token", "bucket"], "left_anti")
    return (
        on_template.select("doc_id", "field", F.substring_index("token", ":", 1).alias("kind"), F.lit("template").alias("part"))
        .unionByName(remaining.select("doc_id", "field", F.col("language").alias("kind"), F.lit("slot").alias("part")))
        .distinct()
    )


def slots_of(text: str, classes: list[list[str]]) -> list[tuple[str, str]]:
    """``(place, value)`` of the slots that the nested classes leave on a page. The place names
    the template tokens that a slot lies between, from outside in; values are clean text, and
    empty ones are left out."""
    member = {t: k for k, names in enumerate(classes) for t in names}
    marks = []
    for language, kind, start, end in signs(text):
        t = name(text[start:end], language, kind)
        if t in member:
            marks.append((t, start, end))
    stack: list[str] = []
    out: list[tuple[str, str]] = []
    at = 0
    for t, start, end in [*marks, ("", len(text), len(text))]:
        value = clean(text[at:start]).strip()
        if value:
            out.append((" ".join(stack), value))
        at = end
        if ":/" in t or ":end" in t:
            opening = t.replace(":/", ":").replace(":end", ":begin")
            if opening in stack:
                del stack[len(stack) - 1 - stack[::-1].index(opening) :]
        elif t and any(x in member for x in (t.replace(":", ":/", 1), t.replace(":begin", ":end"))):
            stack.append(t)
    return out


def _with_templates(pages: DataFrame, classes: DataFrame, found: DataFrame | None, how: str) -> DataFrame:
    on = page_templates(tokens(pages) if found is None else found, classes)
    return pages.select("doc_id", "field", "value").join(on.hint("merge"), ["doc_id", "field"], how)


def slots(pages: DataFrame, classes: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``doc_id, field, slot, place, value`` of every page that was made from a template, i.e. holds
    a class; ``found`` are the pages' tokens where they are known already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "field", "slot", "place", "value"]
        for batch in batches:
            out: list[tuple] = []
            for i, field, text, known in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                out += [(i, field, k, place, value) for k, (place, value) in enumerate(slots_of(text, known))]
            if out:
                types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()]
                columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    joined = _with_templates(pages, classes, found, "inner").select("doc_id", "field", "value", "classes")
    return joined.mapInArrow(run, "doc_id long, field string, slot int, place string, value string")


def cleaned(pages: DataFrame, classes: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """``doc_id, field, clean`` of every filled field. Where ``classes`` are given, a page that was
    made from a template is put together from the template's structure and its slots; all other
    pages, and all where none are given, are read sign by sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * batch.num_rows
            texts = [clean(x, c) for x, c in zip(batch.column(2).to_pylist(), known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "field", "clean"]
            )

    rows = pages.select("doc_id", "field", "value") if classes is None else _with_templates(pages, classes, found, "left")
    return rows.select("doc_id", "field", "value", *([] if classes is None else ["classes"])).mapInArrow(
        run, "doc_id long, field string, clean string"
    )
