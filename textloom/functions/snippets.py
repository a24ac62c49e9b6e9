"""Snippets with the matched words marked, made for the few rows of a result."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Occurrences that are looked at.
MOST_HITS = 25


def _window(text: str, words: list[str], size: int) -> int | None:
    """Where the stretch of ``size`` characters with the most occurrences begins."""
    lower, hits = text.lower(), []
    for w in words:
        at = lower.find(w)
        while at >= 0:
            hits.append(at)
            if len(hits) > MOST_HITS:
                break
            at = lower.find(w, at + len(w))
    if not hits:
        near = (lower.find(w[:4]) for w in words)
        hits = [next((x for x in near if x >= 0), -1)]
    hits = sorted(x for x in hits if x >= 0)
    return max(hits, key=lambda a: (sum(a <= x <= a + size for x in hits), -a), default=None)


def highlight(text: str, words: list[str]) -> str:
    """``**`` around words that begin with one of ``words``, in any case."""
    for w in words:
        marked = re.compile(rf"\b({re.escape(w)}\w*)\b", re.I | re.A)
        text = marked.sub(lambda m: m[0] if m[0].startswith("**") else f"**{m[0]}**", text)
    return re.sub(r"\*{4,}", "**", text)


def make_snippet(text: str | None, strings: list[str], size: int = 150) -> str | None:
    """The densest stretch around occurrences of the scoring strings, or of the first four
    characters of one, cut sides shown by dots; the beginning if nothing occurs."""
    if not text:
        return None
    words = [w for w in (s.strip().lower() for s in strings) if len(w) > 1]
    if not words:
        return text[:size] + "..." if len(text) > size else text
    best = _window(text, words, size)
    start = 0 if best is None else max(0, best - size // 2)
    end = min(len(text), start + size)
    shown = text[start:end].strip()
    return highlight(("..." if start else "") + shown + ("..." if end < len(text) else ""), words)


def snippet(text: Column, strings: list[str], matched: Column, size: int = 150) -> Column:
    """Column form; the scoring strings of the query, then those that only the row matched."""
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series, found: pd.Series) -> pd.Series:
        rows = zip(texts, found, strict=True)
        return pd.Series([make_snippet(t, list(dict.fromkeys([*strings, *(m if m is not None else [])])), size) for t, m in rows])

    return run(text, matched)
