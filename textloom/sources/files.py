"""Documents from folders of files: text and code, JSON, HTML, office files, uploads."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from textloom.operators.numbering import numbered

# Endings that are read as plain text, folders that are passed by, largest file.
TEXT_ENDINGS = """.txt .md .markdown .rst .csv .tsv .log .ts .tsx .js .jsx .mjs .cjs .py .rs .go .java .c .cpp .h .hpp .cs .rb .php
.swift .kt .html .css .scss .yaml .yml .toml .sql .sh .bash .zsh .env""".split()
IGNORED_FOLDERS = """node_modules dist build out target __pycache__ venv""".split()
LARGEST = 20 * 1024 * 1024

_PARTS = re.compile(r"ppt/slides/slide\d+\.xml|word/document\.xml")


# What an element's opening tag leaves in readable text; a name stands for all that begin with it.
ELEMENT_LEAVES = {
    "\n\n### ": "h1 h2 h3 h4 h5 h6 section",
    "\n• ": "li",
    "\n": "p div article tr table header footer blockquote",
}
# Elements that leave nothing with all they hold; any other tag leaves a space.
ELEMENTS_DROPPED = ("style", "script")
# Fixed value: the title of a page.
PAGE_TITLE = r"(?i)<title[^>]*>([^<]+)</title>"

_LEAVES = {name: left for left, names in ELEMENT_LEAVES.items() for name in names.split()}
_DROPPED = "|".join(f"<{n}[^>]*>.*?</{n}>" for n in ELEMENTS_DROPPED)
#: A text in pieces: dropped elements, tags that leave something, text, and signs that begin neither.
HTML_PIECES = f"(?is){_DROPPED}|<(?:{'|'.join(_LEAVES)})[^>]*>|[^<]+|<"


def html_title(content: Column, otherwise: Column) -> Column:
    title = F.trim(F.regexp_extract(content, PAGE_TITLE, 1))
    return F.when(title != "", title).otherwise(otherwise)


def html_text(content: Column) -> Column:
    """HTML as readable text: no styles and scripts; headings and sections begin with ``###``,
    list items with a bullet, blocks on a line of their own; other tags become a space. Lines
    are trimmed and runs of blank ones shortened. Where nothing is left the content stays."""
    leaves = F.create_map(*(F.lit(x) for pair in _LEAVES.items() for x in pair))
    dropped = F.concat(*(F.lit(f"|{n}|") for n in ELEMENTS_DROPPED))

    def left(piece: Column) -> Column:
        name = F.lower(F.regexp_extract(piece, rf"(?i)^<({'|'.join(ELEMENTS_DROPPED)}|{'|'.join(_LEAVES)})[^>]*>", 1))
        gone = dropped.contains(F.concat(F.lit("|"), name, F.lit("|")))
        return F.when(name == "", piece).when(gone, "").otherwise(leaves[name])

    pieces = F.transform(F.regexp_extract_all(content, F.lit(HTML_PIECES), F.lit(0)), left)
    lines = F.split(F.regexp_replace(F.array_join(pieces, ""), "<[^>]+>", " "), "\n")
    text = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")
    return F.when(text != "", text).otherwise(content)


def office_text(data: bytes) -> str:
    """Text of the slides or the body of an office file; empty where it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            parts = [z.read(n).decode("utf-8", "replace") for n in z.namelist() if _PARTS.fullmatch(n)]
    except (zipfile.BadZipFile, ValueError, EOFError, RuntimeError, NotImplementedError, zipfile.LargeZipFile):
        return ""
    return re.sub(r"\s+", " ", " ".join(re.sub(r"<[^>]+>", " ", p) for p in parts)).strip()


_DOC = T.StructType(
    [
        T.StructField("path", T.StringType()), T.StructField("item", T.IntegerType()), T.StructField("own_id", T.StringType()),
        T.StructField("title", T.StringType()), T.StructField("body", T.StringType()), T.StructField("text", T.StringType()),
        T.StructField("extra", T.StringType()),
    ]
)


def _json_docs(path: str, raw: str) -> Iterator[tuple]:
    """One document per item of an array or for one object; invalid JSON gives none. Text that
    is no string, and further keys, go to ``extra`` as JSON."""
    try:
        value = json.loads(raw)
    except ValueError:
        return
    for k, item in enumerate(value if isinstance(value, list) else [value]):
        if not isinstance(item, dict):
            continue
        known = {n: item[n] for n in ("title", "body", "text") if isinstance(item.get(n), str)}
        extra = {n: v for n, v in item.items() if n not in known and n != "id"}
        own = None if item.get("id") is None else str(item["id"])
        title = known.get("title", path if "text" not in known and "body" in known else None)
        yield path, k, own, title, known.get("body"), known.get("text"), json.dumps(extra) if extra else None


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows: list[tuple] = []
        for path, content in zip(frame["path"], frame["content"], strict=True):
            ending = re.sub(r".*(\.[^./]*)$", r"\1", path.lower())
            data = bytes(content)
            if ending in (".pptx", ".docx"):
                if text := office_text(data):
                    rows.append((path, 0, None, path, text, None, None))
            elif ending == ".json":
                rows += _json_docs(path, data.decode("utf-8", "replace"))
            elif b"\0" not in data:
                rows.append((path, 0, None, path, data.decode("utf-8", "replace"), None, None))
        yield pd.DataFrame(rows, columns=_DOC.names)


def _paths(spark: SparkSession, root: str, largest: int) -> list[str]:
    """Files below ``root`` that are to be read, found by names and sizes alone; folders that are
    passed by aren't listed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    endings = (*TEXT_ENDINGS, ".json", ".pptx", ".docx")
    folders, found = [path(root)], []
    while folders:
        for entry in fs.listStatus(folders.pop()):
            name = entry.getPath().getName()
            if name.startswith("."):
                continue
            if entry.isDirectory():
                if name not in IGNORED_FOLDERS:
                    folders.append(entry.getPath())
            elif name.lower().endswith(endings) and entry.getLen() <= largest:
                found.append(entry.getPath().toString())
    return found


def read_folder(spark: SparkSession, folder: str, largest: int = LARGEST) -> DataFrame:
    """``path, item, own_id, title, body, text, extra`` of the documents below a folder.

    Entries that begin with a dot, IGNORED_FOLDERS, files above ``largest`` bytes and other
    endings are passed by, files with NUL bytes too. The title is the path from the folder on.
    Names and sizes are listed by the driver, as for any table of files; contents are read by
    the executors, and only those of the files that are kept.
    """
    root = re.sub(r"/+$", "", folder)
    found = _paths(spark, root, largest)
    if not found:
        return spark.createDataFrame([], _DOC)
    relative = F.regexp_replace("path", "^.*?" + re.escape(re.sub(r"^\w+:/*", "/", root)) + "/", "")
    kept, hidden = [], []
    for x in found:  # Spark takes names that begin with an underscore for files of its own and leaves them out
        (hidden if "/_" in x[len(root) :] or x.rpartition("/")[2].startswith("_") else kept).append(x)
    contents = []
    if kept:
        contents.append(spark.read.format("binaryFile").load(kept).select("path", "content"))
    if hidden:
        paths = spark.createDataFrame([(x,) for x in hidden], "path string").repartition(min(len(hidden), 200))
        contents.append(paths.mapInPandas(_open, "path string, content binary"))
    return reduce(DataFrame.unionByName, contents).select(relative.alias("path"), "content").mapInPandas(_read, _DOC)


def _open(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for frame in frames:
        for uri in frame["path"]:
            system, path = fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", uri))
            with system.open_input_file(path) as f:
                yield pd.DataFrame({"path": [uri], "content": [f.read()]})


def with_ids(docs: DataFrame, first: int = 1) -> DataFrame:
    """Documents with ``doc_id``: their own if it is a number, else counted from ``first`` in
    the order of path and item, past every own one; so generated and own ids never collide."""
    own = F.expr("try_cast(own_id AS BIGINT)")
    named = docs.withColumn("doc_id", own)
    top = named.agg(F.max("doc_id")).first()[0]
    start = first if top is None else max(first, top + 1)
    counted = numbered(named.where("doc_id is null").drop("doc_id"), ["path", "item"], "doc_id", start)
    return named.where("doc_id is not null").unionByName(counted).drop("own_id")


def uploaded(files: DataFrame, next_id: int = 1) -> DataFrame:
    """Documents of uploaded files ``name, content``: JSON by item (text if it is invalid), HTML
    as readable text under its title, anything else as it is. Ids count on from ``next_id``."""
    lower = F.lower("name")
    is_html = lower.rlike(r"\.html?$") | F.col("content").rlike(r"(?is)^\s*<!doctype\s+html")
    parsed = F.try_parse_json("content") if hasattr(F, "try_parse_json") else F.lit(None)
    is_json = lower.endswith(".json") & parsed.isNotNull()
    plain = files.where(~is_json | F.col("content").isNull()).select(
        F.col("name").alias("path"), F.lit(0).alias("item"), F.lit(None).cast("string").alias("own_id"),
        F.when(is_html, html_title(F.col("content"), F.col("name"))).otherwise(F.col("name")).alias("title"),
        F.when(is_html, html_text(F.col("content"))).otherwise(F.coalesce("content", F.lit(""))).alias("body"),
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("extra"),
    )

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [x for n, c in zip(frame["name"], frame["content"], strict=True) for x in _json_docs(n, c)]
            yield pd.DataFrame(rows, columns=_DOC.names)

    items = files.where(is_json).select("name", "content").mapInPandas(read, _DOC)
    return with_ids(plain.unionByName(items), next_id)


def single(spark: SparkSession, doc_id: int, title: str | None = None, body: str | None = None, path: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """One document as a row; a missing title is "Untitled Document", a missing body empty."""
    row = [(doc_id, title or "Untitled Document", body or "", path, tags)]
    return spark.createDataFrame(row, "doc_id long, title string, body string, path string, tags array<string>")


def imported(items: DataFrame) -> DataFrame:
    """Bulk import keeps items with a title or a body."""
    return items.where((F.length(F.coalesce("title", F.lit(""))) > 0) | (F.length(F.coalesce("body", F.lit(""))) > 0))
