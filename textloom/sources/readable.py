"""Readable documents: title, text and kind of pages, JSON, Markdown and other files."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Elements that are no content, and those without an end.
NO_CONTENT = "style script noscript svg link iframe meta".split()
WITHOUT_END = "area base br col embed hr img input link meta param source track wbr".split()
# Elements that stand on lines of their own, and classes of a presentation.
BLOCKS = "p div section article li ol ul tr table header footer blockquote main dd dt".split()
PRESENTATION = {"reveal", "slides", "presentation", "slide"}
# Kinds of documents by the ending of their name.
KINDS = {".pdf": "PDF Document", ".docx": "Word Document", ".pptx": "PowerPoint Document", ".md": "Markdown"}
_HEADINGS = re.compile(r"h[1-6]")
_PAGE = re.compile(r"^\s*<!doctype\s+html|<(?:html|head|body)[\s>]", re.I)


class _Page(HTMLParser):
    """Collects the blocks of a page: each open element has its own text, which goes to its parent's
    when it ends."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, set[str], list[str]]] = [("", set(), [])]
        self.title, self.heading, self.slides = "", "", False

    def _text(self, k: int = -1) -> str:
        return "".join(self.open[k][2])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        classes = set((dict(attrs).get("class") or "").split())
        self.slides |= bool(classes & PRESENTATION)
        if tag in ("li", "p", "tr", "td", "th", "dd", "dt") and self.open[-1][0] == tag:
            self._close()
        if tag == "br":
            self.open[-1][2].append("\n")
        elif tag == "hr":
            self.open[-1][2].append("\n\n---\n\n")
        elif tag not in WITHOUT_END:
            self.open.append((tag, classes, []))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, *_ in self.open[1:]):
            while self.open[-1][0] != tag:
                self._close()
            self._close()

    def handle_data(self, data: str) -> None:
        text = re.sub(r"[\r\n\t]+", " ", data).strip()
        if text:
            own = self._text()
            self.open[-1][2].append((" " if own and own[-1] not in "\n " else "") + text)

    def _close(self) -> None:
        tag, classes, parts = self.open.pop()
        text = "".join(parts)
        if tag == "title":
            self.title = self.title or text.strip()
            return
        if tag in NO_CONTENT or (tag == "button" and "theme-toggle" in classes):
            return
        heading, section = bool(_HEADINGS.fullmatch(tag)), tag == "section" or "slide" in classes
        if tag in ("h1", "h2", "header") or classes & {"title", "title-slide"}:
            self.heading = self.heading or text.strip().split("\n")[0].strip()
        block = tag in BLOCKS
        before = "\n\n### " if section or heading else "\n• " if tag == "li" else "\n\n" if block else " | " if tag in ("td", "th") else ""
        self.open[-1][2].append(before + text + ("\n" if section or heading or block else ""))

    def body(self) -> str:
        self.close()
        while len(self.open) > 1:
            self._close()
        out: list[str] = []
        blank = False
        for line in (x.strip() for x in self._text().split("\n")):
            if line != "###" and not (not line and blank):
                out.append(line)
            blank = not line
        return "\n".join(out).strip()


def _json_text(content: str) -> str | None:
    try:
        value = json.loads(content)
    except ValueError:
        return None
    shown = lambda v: v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False)
    if isinstance(value, list):
        items = (x if isinstance(x, str) else " — ".join(v for v in x.values() if isinstance(v, str)) if isinstance(x, dict) else "" for x in value)
        return "\n\n".join(items)
    return "\n".join(f"{k}: {shown(v)}" for k, v in value.items()) if isinstance(value, dict) else ""


def read_one(content: str | None, name: str | None = None) -> tuple[str, str, str]:
    """``(title, body, kind)`` of one document. Pages are told by name or content, JSON by name or its
    first sign; a page that leaves nothing, or JSON that can't be read, keeps its content."""
    name = name or ""
    if not content:
        return name or "Untitled Document", "", "Text Document"
    ending = re.sub(r".*(?=\.)", "", name.lower())
    if ending in (".html", ".htm") or _PAGE.search(content):
        page = _Page()
        page.feed(content)
        body = page.body()
        slides = page.slides or "reveal.js" in content
        return page.title or page.heading or name or "HTML Document", body or content, "HTML Presentation" if slides else "HTML Document"
    if ending == ".json" or content.strip()[:1] in ("{", "["):
        text = _json_text(content)
        if text is not None:
            return name or "JSON Data", text or content, "JSON Data"
    first = re.search(r"^#\s+(.+)$", content, re.M) if ending == ".md" else None
    return first[1].strip() if first else name or "Text Document", content, KINDS.get(ending, "Text Document")


def readable(docs: DataFrame, key: str, content: Column, name: Column) -> DataFrame:
    """``key, title, body, doc_type`` of every row; contents are read by the executors, row by row as
    each is a document of its own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [read_one(c, n) for c, n in zip(frame["content"], frame["name"], strict=True)]
            yield pd.DataFrame({"key": frame["key"], **{c: [r[k] for r in rows] for k, c in enumerate(("title", "body", "doc_type"))}})

    rows = docs.select(F.col(key).alias("key"), content.alias("content"), name.alias("name"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, title string, body string, doc_type string").withColumnRenamed("key", key)
