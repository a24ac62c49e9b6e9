"""Text analysis as Columns: character filters, tokens, bounds, stop words, stems."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass, replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from textloom.functions.words import STOP_WORDS, stem, strip_marks

#: A token: a longest run of letters, digits and underscores.
TOKEN = r"[\p{L}\p{N}_]+"


@dataclass(frozen=True)
class AnalyzerConfig:
    """Options of the analysis. ``stop_words``: True for the default list, False for none, or
    words of one's own (lower-cased if given as a list, as they are in a set)."""

    lowercase: bool = True
    strip_html: bool = False
    strip_diacritics: bool = True
    stop_words: bool | tuple[str, ...] | frozenset[str] = True
    stemming: bool = True
    min_token_length: int = 1
    max_token_length: int = 64

    @staticmethod
    def of(**options) -> AnalyzerConfig:
        words = options.get("stop_words")
        if isinstance(words, set | frozenset):
            options["stop_words"] = frozenset(words)
        elif words is not None and not isinstance(words, bool):
            options["stop_words"] = tuple(w.lower() for w in words)
        return replace(AnalyzerConfig(), **options)

    def words(self) -> frozenset[str]:
        if isinstance(self.stop_words, bool):
            return STOP_WORDS if self.stop_words else frozenset()
        return frozenset(self.stop_words)

    def to_dict(self) -> dict:
        d = asdict(self)
        d["stop_words"] = d["stop_words"] if isinstance(self.stop_words, bool) else sorted(self.words())
        return d

    @staticmethod
    def from_dict(d: dict) -> AnalyzerConfig:
        words = d["stop_words"]
        return replace(AnalyzerConfig(), **{**d, "stop_words": words if isinstance(words, bool) else frozenset(words)})


def strip_html(c: Column) -> Column:
    """Every tag becomes one space."""
    return F.regexp_replace(c, "<[^>]*>", " ")


#: Stretches of characters that the fast path of folding covers.
SAFE_RANGES = 24


@lru_cache(maxsize=1)
def _fold_map() -> tuple[str, str, str]:
    """Characters of the basic plane that fold to one character, what they fold to, and a
    pattern that holds at least for all characters that fold to none or several."""
    one, to, many = [], [], []
    for cp in range(0x80, 0x10000):
        c = chr(cp)
        if 0xD800 <= cp < 0xE000:
            many.append(cp)
        elif (f := strip_marks(c)) != c:
            if len(f) == 1:
                one.append(c)
                to.append(f)
            elif not 0x300 <= cp <= 0x36F:
                many.append(cp)
    # the longest stretches without such characters; a class of few ranges is matched fast,
    # and what lies between them may take the slow path without need but never wrongly
    edges = [-1, *many, 0x10000]
    gaps = sorted(((b - a - 1, a + 1, b - 1) for a, b in zip(edges, edges[1:], strict=False)), reverse=True)[:SAFE_RANGES]
    safe = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for _, a, b in sorted(gaps, key=lambda g: g[1]) if a <= b)
    return "".join(one), "".join(to), f"[^{safe}]"


@F.pandas_udf(T.StringType())
def _strip_marks(s):
    return s.map(strip_marks, na_action="ignore")


def strip_diacritics(c: Column) -> Column:
    """Compatibility decomposition without combining marks from U+0300 to U+036F. ASCII texts
    pass; characters that fold one to one are translated in the JVM; only texts that hold one
    which folds to none or several go to a Pandas function (the others reach it as nulls)."""
    one, to, many = _fold_map()
    hard = c.rlike(many)
    plain = F.regexp_replace(F.translate(c, one, to), r"[\x{300}-\x{36f}]", "")
    return (
        F.when(~c.rlike(r"[^\x00-\x7f]"), c)
        .when(hard, _strip_marks(F.when(hard, c)))
        .otherwise(plain)
    )


def filter_chars(c: Column, config: AnalyzerConfig) -> Column:
    if config.strip_html:
        c = strip_html(c)
    if config.strip_diacritics:
        c = strip_diacritics(c)
    return F.lower(c) if config.lowercase else c


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, in which token bounds and offsets are stated."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def kept(words: Column, config: AnalyzerConfig) -> Column:
    """Words within the length bounds that are no stop words, in order."""
    low, high, stop = config.min_token_length, config.max_token_length, sorted(config.words())

    def keep(x: Column) -> Column:
        fits = F.when(F.length(x) * 2 <= high, F.length(x) >= low).otherwise(utf16_length(x).between(low, high))
        return fits & ~x.isin(stop) if stop else fits

    return F.filter(words, keep)


def _stem_lists(lists: pa.ListArray) -> pa.ListArray:
    flat = lists.flatten()
    if not len(flat):
        return lists.cast(pa.list_(pa.string()))
    coded = flat.dictionary_encode()
    stems = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    sizes = lists.value_lengths().fill_null(0).to_pylist()
    offsets = [0]
    for n in sizes:
        offsets.append(offsets[-1] + n)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), stems.take(coded.indices))


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_all(lists: pa.Array) -> pa.Array:
    """Stems of lists of words; each distinct word of a batch is stemmed once."""
    return _stem_lists(lists)


@F.arrow_udf(T.StringType())
def stem_word(words: pa.Array) -> pa.Array:
    coded = words.dictionary_encode()
    return pa.array([None if w is None else stem(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def tokens(c: Column, config: AnalyzerConfig | None = None) -> Column:
    """``array<string>`` of a text's terms; a term's index is its position, so words that are
    left out leave no gap. Null texts have none."""
    config = config or AnalyzerConfig()
    words = F.regexp_extract_all(filter_chars(c, config), F.lit(f"({TOKEN})"), F.lit(1))
    words = F.coalesce(kept(words, config), F.array().cast("array<string>"))
    return stem_all(words) if config.stemming else words


def analyze_text(text: str, config: AnalyzerConfig | None = None) -> list[tuple[str, int, int, int]]:
    """``(term, position, start, end)`` of one text on the driver or in a worker; offsets count
    UTF-16 units of the filtered text."""
    import regex

    config = config or AnalyzerConfig()
    if config.strip_html:
        text = regex.sub("<[^>]*>", " ", text)
    if config.strip_diacritics:
        text = strip_marks(text)
    if config.lowercase:
        text = text.lower()
    stop, out = config.words(), []
    wide = not text.isascii() and any(ord(c) > 0xFFFF for c in text)
    for m in regex.finditer(TOKEN, text):
        word = m[0]
        size = len(word.encode("utf-16-le")) // 2 if wide else len(word)
        if not config.min_token_length <= size <= config.max_token_length or word in stop:
            continue
        start = len(text[: m.start()].encode("utf-16-le")) // 2 if wide else m.start()
        out.append((stem(word) if config.stemming else word, len(out), start, start + size))
    return out


def analyze(c: Column, config: AnalyzerConfig | None = None) -> Column:
    """``array<struct<term, position, start_offset, end_offset>>`` of a text, offsets in UTF-16
    units of the filtered text."""
    config = config or AnalyzerConfig()
    kind = "array<struct<term:string,position:int,start_offset:int,end_offset:int>>"
    names = ("term", "position", "start_offset", "end_offset")
    arrow = pa.list_(pa.struct([("term", pa.string()), *((n, pa.int32()) for n in names[1:])]))

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        rows = [[dict(zip(names, t, strict=True)) for t in analyze_text(x or "", config)] for x in texts.to_pylist()]
        return pa.array(rows, arrow)

    return run(c)


def normalize_term(term: str, config: AnalyzerConfig | None = None) -> str:
    """The lexicon form of one query word: folded, lower-cased and stemmed, nothing else."""
    config = config or AnalyzerConfig()
    if config.strip_diacritics:
        term = strip_marks(term)
    if config.lowercase:
        term = term.lower()
    return stem(term) if config.stemming else term


def text_of(columns: Iterable[tuple[str, str]], key: str = "id") -> Column:
    """The searchable text of a record with ``(name, type)`` columns: ``text`` if it isn't null,
    even if empty; else title and body joined by a space, empty ones left out; else all string
    columns but the key, in their order, joined by spaces."""
    types = dict(columns)
    blank = F.lit(None).cast("string")
    col = lambda n: F.col(f"`{n}`") if types.get(n) == "string" else blank
    filled = lambda n: F.when(F.length(col(n)) > 0, col(n))
    titled = F.concat_ws(" ", filled("title"), filled("body"))
    rest = F.concat_ws(" ", *(F.col(f"`{n}`") for n, t in types.items() if t == "string" and n != key))
    return F.coalesce(col("text"), F.when(titled != "", titled), rest)
