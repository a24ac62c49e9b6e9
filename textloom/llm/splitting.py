"""Splitting oversized texts at natural boundaries: packing of a structure tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Limits where an option is missing or null.
PIECE_CHARS, PIECE_OVERLAP, MAX_TOKEN = 1200, 0, 64

_LINE = re.compile(r"\n|(?=<(?:h[1-6]|p|div|ul|ol|li|table|tr|pre|blockquote|section|nav|body)\b)", re.I)
_HEADING = re.compile(
    r"\s*(?:(?P<md>\#{1,6})\s|(?P<wiki>={1,6})[^=\n]+(?P=wiki)\s*$|\\(?P<tex>(?:sub)*section|chapter|part)\b|<h(?P<html>[1-6])\b)", re.I
)
_ITEM = re.compile(r"(\s*)(?:[-+•]\s|\*+\s|\#+\s|\d+[.)]\s|\\item\b|<li\b)", re.I)
_OPEN = re.compile(r"\s*(?:(?P<fence>```|~~~)|\\begin\{(?P<env>\w+)\*?\}|<(?P<pre>pre)\b)", re.I)
#: Boundaries inside a line, coarsest first: sentences, clauses, words.
_WITHIN = [
    re.compile(r"(?<=[.!?…])[\"'»”)\]]*\s+|(?<=[。！？])"), re.compile(r"(?<=[,;:])\s+|(?<=[、，；：])|\s+(?=[–—(])"),
    re.compile(r"\s+|(?<=[^\w\s])(?=\w)"),
]
#: Boundaries inside a word, coarsest first.
_INSIDE = [re.compile(r"(?<=_)(?=[^_])"), re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])|(?<=\d)(?=\D)|(?<=\D)(?=\d)")]


@dataclass
class Node:
    """A stretch of the text; ``children`` cover it in order, or are worked out when needed."""

    start: int
    end: int
    rank: int
    children: list[Node] = field(default_factory=list)
    heading: bool = False


def parse(text: str) -> Node:
    """The structure tree: sections below headings (Markdown, wiki, LaTeX or HTML), below them
    paragraphs, list items by indentation and fenced or verbatim blocks, below them lines."""
    starts = sorted({0, *(m.end() for m in _LINE.finditer(text) if m.end() < len(text))})
    root = Node(0, len(text), 0)
    stack, blank, closing = [root], True, ""
    for start, end in zip(starts, [*starts[1:], len(text)], strict=True):
        line = text[start:end]
        bare = line.strip()
        rank = 20
        if closing:
            if closing in line.lower():
                closing = ""
        elif m := _HEADING.match(line):
            kind, mark = m.lastgroup, m[m.lastgroup or 0]
            rank = {"md": len(mark), "wiki": len(mark), "html": 0}.get(kind or "", 0) or (
                int(mark) if kind == "html" else 1 + mark.lower().count("sub") + (mark.lower().endswith("section"))
            )
        elif m := _ITEM.match(line):
            rank = 8 + min(len(m[1].expandtabs(4)) // 2, 10)
        elif bare and blank:
            rank = 7
        if not closing and rank > 6 and (m := _OPEN.match(line)):
            closer = m["fence"] or (m["env"] and f"\\end{{{m['env'].lower()}") or "</pre"
            if closer not in line[m.end() :].lower():
                closing = closer
        blank = not bare and not closing
        while stack[-1].rank >= rank and len(stack) > 1:
            stack.pop()
        node = Node(start, end, rank)
        if rank < 20:
            node.children.append(Node(start, end, 20, heading=rank <= 6))
        stack[-1].children.append(node)
        if rank < 20:
            stack.append(node)

    return root


def _close(node: Node) -> int:
    """Ends of nodes are the ends of their last children; nesting is at most 20 deep."""
    if node.children:
        node.end = max(_close(child) for child in node.children)
    return node.end


def _parts(text: str, node: Node, boundaries: list[re.Pattern[str]], level: int) -> tuple[list[Node], int]:
    """Children of a leaf at the first boundary kind from ``level`` on that parts it."""
    while level < len(boundaries):
        cuts = [m.end() for m in boundaries[level].finditer(text, node.start, node.end) if node.start < m.end() < node.end]
        level += 1
        if cuts:
            edges = [node.start, *dict.fromkeys(cuts), node.end]
            return [Node(a, b, 20 + level) for a, b in zip(edges, edges[1:], strict=False)], level
    return [], level


def _is_mark(c: str) -> bool:
    return "\u0300" <= c <= "\u036f" or c in "‍️" or "\U0001f3fb" <= c <= "\U0001f3ff"


def pack(text: str, root: Node, limit: int, overlap: int, boundaries: list[re.Pattern[str]]) -> list[tuple[int, int]]:
    """Cuts of ``text`` as ``(start, end)`` in order, each of at most ``limit - overlap``
    characters (the first of ``limit``).

    Sibling subtrees merge while they fit; only a node that is too large by itself is descended
    into, last of all between its characters. A piece that is less than half full where a
    descent begins or ends stays open, so what is left over merges with its neighbours. A
    heading goes on with what follows it: it moves to the next piece if nothing else would
    follow it, and what follows a piece that is a heading alone is descended into for its sake.
    """
    out: list[tuple[int, int]] = []
    open_ = False
    heading = -1  # where the heading begins that the open piece ends with

    def room() -> int:
        return limit if len(out) == 1 else limit - overlap

    def put(a: int, b: int, is_heading: bool = False) -> None:
        nonlocal open_, heading
        if out and open_ and b - out[-1][0] <= room():
            out[-1] = (out[-1][0], b)
        elif open_ and out and heading > out[-1][0] and b - heading <= limit - overlap:
            out[-1] = (out[-1][0], heading)
            out.append((heading, b))
        else:
            out.append((a, b))
            heading = -1
        open_ = True
        if is_heading:
            heading = a if heading < 0 else heading
        elif not text[a:b].isspace():
            heading = -1

    def visit(node: Node, level: int) -> None:
        nonlocal open_
        fits = node.end - node.start <= (limit - overlap if out else limit)
        alone = bool(out) and open_ and heading == out[-1][0] and node.end - heading > room()
        if fits and not alone:
            put(node.start, node.end, node.heading or (node.rank <= 6 and len(node.children) == 1))
            return
        children = node.children
        if not children:
            children, level = _parts(text, node, boundaries, level)
        if children:
            for k in range(len(children) + 1):
                if k in (0, len(children)) and out and heading < 0 and 2 * (out[-1][1] - out[-1][0]) >= room():
                    open_ = False
                if k < len(children):
                    visit(children[k], level)
            return
        if fits:
            put(node.start, node.end)
            return
        a = node.start
        while a < node.end:
            b = min(node.end, a + (limit - overlap if out else limit))
            while b < node.end and b > a + 1 and _is_mark(text[b]):
                b -= 1
            put(a, b)
            a = b

    visit(root, 0)
    return out


def split(text: str, limit: int, overlap: int, word: bool = False) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces of a text, or of one unbroken word.

    Every piece has at most ``limit`` characters; each but the first starts exactly ``overlap``
    characters before the end of the one before it (at the text's beginning where that has
    fewer), so pieces without their overlap join to the text. A text within the limit is one
    piece, the empty one too. Any overlap below the limit is kept; a larger one, with which no
    piece could move on, is lowered to one character less than the limit.
    """
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    if len(text) <= limit:
        return [(0, len(text))]
    if word:
        cuts = pack(text, Node(0, len(text), 20), limit, overlap, _INSIDE)
    else:
        root = parse(text)
        _close(root)
        cuts = pack(text, root, limit, overlap, [*_WITHIN, *_INSIDE])
    return [(max(0, a - overlap), b) for a, b in cuts]


def _long_words(text: str, most: int, known: dict[int, re.Pattern[str]]) -> Iterator[re.Match[str]]:
    pattern = known.setdefault(most, re.compile(rf"(?<!\w)\w{{{most + 1},}}"))
    return pattern.finditer(text)


PIECES = pa.schema(
    [
        ("doc_id", pa.int64()), ("kind", pa.string()), ("start_offset", pa.int32()), ("piece", pa.int32()),
        ("piece_start", pa.int32()), ("piece_end", pa.int32()), ("content", pa.string()),
    ]
)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[int, re.Pattern[str]] = {}
    for batch in batches:
        out: list[tuple] = []
        ids, texts, limits, overlaps, words = (batch.column(k).to_pylist() for k in range(5))
        for i, text, limit, overlap, most in zip(ids, texts, limits, overlaps, words, strict=True):
            for k, (a, b) in enumerate(split(text, limit, overlap)):
                out.append((i, "body", 0, k, a, b, text[a:b]))
            for m in _long_words(text, most, known):
                for k, (a, b) in enumerate(split(m[0], most, overlap, word=True)):
                    out.append((i, "token", m.start(), k, a, b, m[0][a:b]))
            if len(out) >= 4096:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES
    )


#: Most rows that an options table may have to be broadcast; a larger one is joined by shuffle.
MOST_OPTIONS = 10_000


def pieces(docs: DataFrame, options: DataFrame) -> DataFrame:
    """Pieces of every body and of every unbroken word that is too long, under the limits of
    the record's options: ``doc_id, kind, start_offset, piece, piece_start, piece_end, content``.

    ``kind`` is 'body' (``start_offset`` 0) or 'token' (a run of letters, digits and underscores
    longer than ``max_token_length``; ``start_offset`` counts the characters before it).
    ``piece_start`` and ``piece_end`` are within the item. A body within its limit, the empty
    one too, is one piece. Null bodies and null ids have none. Repeated rows count once. Where
    the options or one of their values are missing, PIECE_CHARS, PIECE_OVERLAP and MAX_TOKEN
    hold; of options that come twice the smallest values hold. Other columns are ignored.
    """
    limits = options.where("options_id is not null").groupBy("options_id").agg(
        F.min("piece_chars").alias("_limit"), F.min("piece_overlap").alias("_overlap"), F.min("max_token_length").alias("_word")
    )
    few = len(limits.select("options_id").limit(MOST_OPTIONS + 1).collect()) <= MOST_OPTIONS
    kept = docs.where("doc_id is not null and body is not null").select("doc_id", "body", "options_id").distinct()
    return (
        kept.join(F.broadcast(limits) if few else limits, "options_id", "left")
        .select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "body",
            F.coalesce("_limit", F.lit(PIECE_CHARS)).alias("_limit"),
            F.coalesce("_overlap", F.lit(PIECE_OVERLAP)).alias("_overlap"),
            F.coalesce("_word", F.lit(MAX_TOKEN)).alias("_word"),
        )
        .mapInArrow(
            _run,
            "doc_id long, kind string, start_offset int, piece int, piece_start int, piece_end int, content string",
        )
    )


def found(split_items: DataFrame) -> DataFrame:
    """``doc_id, kind, start_offset`` of the items that had to be cut."""
    return split_items.where("piece = 1").select("doc_id", "kind", "start_offset").distinct()
