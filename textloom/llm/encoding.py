"""Encoding of texts with a public tokenizer over Arrow batches, and back."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Folder of the tokenizers' files; never copied into the repository.
TOKENIZERS = os.environ.get("TEXTLOOM_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.json"
#: Texts, and characters, that one call of the tokenizer takes; a longer text goes alone.
CALL_TEXTS, CALL_CHARS = 256, 1 << 20


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker; special tokens' strings are plain text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_padding()
    t.no_truncation()
    return t


def byte_table() -> dict[str, int]:
    """Character to byte of byte-level BPE vocabularies: printable bytes stand for themselves,
    the others for the characters from 256 on, in order."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in kept}
    for k, b in enumerate(b for b in range(256) if b not in set(kept)):
        table[chr(256 + k)] = b
    return table


def groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Slices of ``texts`` for one call each."""
    start, chars = 0, 0
    for k, text in enumerate(texts):
        size = len(text or "")
        if k > start and (k - start >= CALL_TEXTS or chars + size > CALL_CHARS):
            yield start, k
            start, chars = k, 0
        chars += size
    if start < len(texts):
        yield start, len(texts)


def _encoder(path: str, lengths_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        encode = getattr(t, "encode_batch_fast", t.encode_batch)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in groups(texts):
                ids = [e.ids for e in encode([x or "" for x in texts[start:end]], add_special_tokens=False)]
                out = pa.array([len(x) for x in ids], pa.int32()) if lengths_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), out], ["key", "out"])

    return run


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, ids`` of each row's whole text, without special tokens.

    Null and empty texts have the empty list; strings that look like control tokens are plain
    text. One row comes out per row that goes in, without a shuffle; other columns are left.
    """
    path = path or f"{TOKENIZERS}/{BYTE_BPE}"
    pairs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = pairs.schema["key"].dataType.simpleString()
    return pairs.mapInArrow(_encoder(path, False), f"key {kind}, out array<int>").toDF(key, "ids")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, n_tokens`` of each row's whole text; 0 for null and empty texts."""
    path = path or f"{TOKENIZERS}/{BYTE_BPE}"
    pairs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = pairs.schema["key"].dataType.simpleString()
    return pairs.mapInArrow(_encoder(path, True), f"key {kind}, out int").toDF(key, "n_tokens")


def spans(text: str, path: str | None = None) -> list[tuple[int, int, int]]:
    """``(id, start, end)`` of each token in characters of ``text``. Tokens that hold only part
    of a character's bytes all span that character."""
    t = tokenizer(path or f"{TOKENIZERS}/{BYTE_BPE}")
    e = t.encode(text, add_special_tokens=False)
    return [(i, a, b) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]


def encode_spans(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, ids, starts, ends`` of each row's whole text: what ``spans`` gives of one text."""
    path = path or f"{TOKENIZERS}/{BYTE_BPE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.int32())
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                rows = [spans(x or "", path) for x in batch.column(1).slice(k, 64).to_pylist()]
                columns = [pa.array([[t[n] for t in row] for row in rows], lists) for n in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 64), *columns], ["key", "ids", "starts", "ends"])

    pairs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = pairs.schema["key"].dataType.simpleString()
    return pairs.mapInArrow(run, f"key {kind}, ids array<int>, starts array<int>, ends array<int>").toDF(key, "ids", "starts", "ends")


def decode_ids(ids: list[int], path: str | None = None) -> str:
    """Text of ``ids``: vocabulary characters go back to bytes, and the bytes of all tokens
    are joined before UTF-8 is read, so characters split between tokens come back whole."""
    t, table = tokenizer(path or f"{TOKENIZERS}/{BYTE_BPE}"), byte_table()
    return bytes(table[c] for i in ids for c in t.id_to_token(i)).decode("utf-8", errors="replace")


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``key, text`` of each row's ids; null and empty lists give the empty text."""
    path = path or f"{TOKENIZERS}/{BYTE_BPE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, table = tokenizer(path), byte_table()
        pieces: dict[int, bytes] = {}
        for batch in batches:
            out = []
            for row in batch.column(1).to_pylist():
                for i in row or ():
                    if i not in pieces:
                        pieces[i] = bytes(table[c] for c in t.id_to_token(i))
                out.append(b"".join(pieces[i] for i in row or ()).decode("utf-8", errors="replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["key", "text"])

    pairs = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    kind = pairs.schema["key"].dataType.simpleString()
    return pairs.mapInArrow(run, f"key {kind}, text string").toDF(key, "text")
