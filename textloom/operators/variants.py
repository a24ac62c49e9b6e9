"""Search and display modes beside the boolean engine: bags of stems, excerpts, notes, counts."""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from textloom.functions.analysis import AnalyzerConfig, normalize_term, stem_all, stem_word, strip_diacritics
from textloom.functions.words import STOP_WORDS
from textloom.operators import ranking
from textloom.operators.index import Index
from textloom.operators.numbering import ranked

#: Words of the bag modes: letters and digits, no underscore.
WORD = r"[\p{L}\p{N}]+"
#: White space of any script, which is trimmed.
WHITE = r"[\s\p{Z}\x{FEFF}]+"
# Stop words of the engine that the bag modes don't have, and one that only they have.
BAG_STOP_WORDS = STOP_WORDS - frozenset(
    """aren arent can cant couldn couldnt d didn didnt doesn doesnt don dont hadn hadnt hasn hasnt haven havent isn isnt just ll m ma
mightn mightnt mustn mustnt needn neednt now o re s shan shant shouldn shouldnt t ve wasn wasnt weren werent will won wont wouldn
wouldnt y""".split()
) | {"ought"}
#: What a document gains that matches every stem.
ALL_STEMS = 1.35


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WHITE}|{WHITE}$", "")


def bag_tokens(c: Column, least: int = 1, stop_words: frozenset[str] = BAG_STOP_WORDS) -> Column:
    """Stems for the bag modes. The text is decomposed but combining marks stay, so they part
    words; no upper bound; ``least`` 2 drops single characters."""
    decomposed = F.lower(_decomposed(c))
    words = F.regexp_extract_all(decomposed, F.lit(f"({WORD})"), F.lit(1))
    keep = lambda x: (F.length(x) >= least) & ~x.isin(sorted(stop_words))
    return stem_all(F.coalesce(F.filter(words, keep), F.array().cast("array<string>")))


def _decomposed(c: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def nfkd(s):
        return s.map(lambda x: unicodedata.normalize("NFKD", x), na_action="ignore")

    wide = c.rlike(r"[^\x00-\x7f]")
    return F.when(wide, nfkd(F.when(wide, c))).otherwise(c)


def query_stems(query: str, config: AnalyzerConfig | None = None) -> list[str]:
    """Stems of the words of a query that are no stop words, in order; AND, OR and NOT are."""
    import regex

    config = config or AnalyzerConfig()
    words = regex.findall(WORD, query.lower())
    return list(dict.fromkeys(normalize_term(w, config) for w in words if w not in config.words()))


def bag_search(
    index: Index, query: str, *, limit: int = 15, where: Column | None = None, k1: float | None = None, b: float | None = None,
) -> DataFrame:
    """``doc_id, score, matched, breakdown, offsets``: BM25 of a bag of stems.

    Without the word OR and with several stems a document must hold two of them, and holding
    all lifts its score by ALL_STEMS. ``where`` is a condition on stored fields (files, notes).
    ``breakdown`` has tf, idf, norm and score of each stem to two places, ``offsets`` the first
    four positions; scores are rounded to two places.
    """
    stems = query_stems(query, index.config)
    either = " or " in f" {query.lower()} "
    stats = index.totals()
    n, average = F.lit(float(stats["n"])), F.lit(float(stats["avg"]))
    hits = index.postings.where(F.col("term").isin(stems) if stems else F.lit(False))
    if where is not None:
        hits = hits.join(index.docs.where(where).select("doc_id"), "doc_id", "left_semi")
    wanted = index.terms.where(F.col("term").isin(stems) if stems else F.lit(False)).select("term", "df")
    idf = ranking.bm25_idf(F.col("df"), n)
    one = ranking.bm25(F.col("tf"), F.col("length"), average, idf, index.k1 if k1 is None else k1, index.b if b is None else b)
    part = F.struct(
        "term", "tf", F.round(idf, 2).alias("idf"), F.round(one / idf, 2).alias("norm"), F.round(one, 2).alias("score"), "positions"
    )
    grouped = hits.join(F.broadcast(wanted), "term").groupBy("doc_id").agg(  # at most one row per query word
        F.sum(one).alias("raw"), F.count("*").alias("matched"), F.sort_array(F.collect_list(part)).alias("parts")
    )
    if not either and len(stems) > 1:
        grouped = grouped.where(F.col("matched") >= 2)
        raw = F.when(F.col("matched") == len(stems), F.col("raw") * ALL_STEMS).otherwise(F.col("raw"))
    else:
        raw = F.col("raw")
    shown = grouped.select(
        "doc_id", F.round(raw, 2).alias("score"), "matched",
        F.transform("parts", lambda x: x.dropFields("positions")).alias("breakdown"),
        F.slice(F.flatten(F.transform("parts", lambda x: x["positions"])), 1, 4).alias("offsets"),
    )
    return ranking.top(shown, limit)


def _hits(words: Column, stems: list[str], raw: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(stems or [""]) | w.isin(raw or [""])))


def sentences(body: Column) -> Column:
    flat = F.regexp_replace(F.regexp_replace(body, r"###\s+", ""), r"•\s+", "")
    return F.filter(F.transform(F.split(flat, r"(?<=[.!?\n])\s+"), trimmed), lambda s: F.length(s) > 0)


def _words_of(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


# Characters shown of a body where its title matches, and where nothing does.
TITLE_PREVIEW, PREVIEW = 110, 130


def _plain_words(query: str) -> list[str]:
    """Words between blanks, lower-cased, without signs."""
    words = (re.sub(r"[^\w]", "", w, flags=re.A) for w in query.lower().split())
    return [w for w in words if w]


def sentence_snippets(
    docs: DataFrame, query: str, body: str = "body", key: str = "doc_id", config: AnalyzerConfig | None = None, title: str | None = None
) -> DataFrame:
    """``doc_id, snippet, match_count, place``: of each document the sentence with most matching
    words, the first of equals; one above 180 characters is cut to five words before the first
    match and sixteen from it on. Where only the ``title`` matches, and where nothing does, the
    body's beginning (``place`` 'body', 'title' or 'none'). A null body is empty."""
    stems, raw = query_stems(query, config), _plain_words(query)
    best = _best_sentences(docs, stems, raw, body, key)
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(body), F.lit("")), r"###\s+", ""), r"•\s+", "")
    words = _words_of(F.coalesce(F.col(title), F.lit(""))) if title else F.array().cast("array<string>")
    shown = docs.select(key, flat.alias("_flat"), words.alias("_title")).withColumn("_in_title", _both(stem_all(F.col("_title")), F.col("_title"), stems, raw))
    begun = trimmed(F.left("_flat", F.lit(PREVIEW)))
    begun = F.when(F.length("_flat") > PREVIEW, F.concat(begun, F.lit(" …"))).otherwise(begun)
    otherwise = F.when(F.col("_in_title") > 0, trimmed(F.left("_flat", F.lit(TITLE_PREVIEW)))).otherwise(begun)
    place = F.when(F.col("snippet").isNotNull(), "body").when(F.col("_in_title") > 0, "title").otherwise("none")
    return shown.join(best, key, "left").select(
        key, F.coalesce("snippet", otherwise).alias("snippet"),
        F.coalesce("match_count", F.col("_in_title").cast("long")).alias("match_count"), place.alias("place"),
    )


def _best_sentences(docs: DataFrame, stems: list[str], raw: list[str], body: str, key: str) -> DataFrame:
    each = docs.select(key, F.posexplode(sentences(F.col(body))).alias("at", "sentence"))
    each = each.withColumn("_stems", stem_all(_words_of(F.col("sentence")))).withColumn(
        "n", _hits(F.col("_stems"), stems, stems) if not raw else _both(F.col("_stems"), _words_of(F.col("sentence")), stems, raw)
    )
    best = each.where("n > 0").groupBy(key).agg(
        F.max_by("sentence", F.struct("n", -F.col("at"))).alias("best"), F.sum("n").cast("long").alias("match_count")
    )
    parts = F.split("best", r"\s+")
    plain = F.transform(parts, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", ""))
    cut = best.withColumn("_parts", parts).withColumn("_stems", stem_all(plain)).withColumn("_plain", plain)
    match = F.transform("_stems", lambda s, k: s.isin(stems or [""]) | F.element_at("_plain", k + 1).isin(raw or [""]))
    cut = cut.withColumn("_at", F.greatest(F.array_position(match, True) - 1, F.lit(0)).cast("int"))
    start = F.greatest(F.col("_at") - 5, F.lit(0))
    end = F.least(F.col("_at") + 16, F.size("_parts"))
    short = F.concat(
        F.when(start > 0, "… ").otherwise(""), F.array_join(F.slice("_parts", start + 1, end - start), " "),
        F.when(end < F.size("_parts"), " …").otherwise(""),
    )
    return cut.select(key, F.when(F.length("best") > 180, short).otherwise(F.col("best")).alias("snippet"), "match_count")


def _both(stemmed: Column, words: Column, stems: list[str], raw: list[str]) -> Column:
    pairs = F.arrays_zip(stemmed.alias("s"), words.alias("w"))
    return F.size(F.filter(pairs, lambda p: p["s"].isin(stems or [""]) | p["w"].isin(raw or [""])))


def window_snippets(docs: DataFrame, query: str, body: str = "body", key: str = "doc_id", size: int = 28, config: AnalyzerConfig | None = None) -> DataFrame:
    """``doc_id, snippet``: ``size`` words from four before the first word whose stem matches,
    matches in ``<mark>``; from the first word where none does."""
    stems = query_stems(query, config)
    plain = F.transform("_words", lambda w: F.regexp_replace(F.lower(w), r"[^\w]", ""))
    flat = F.regexp_replace(F.regexp_replace(F.col(body), r"###\s+", ""), r"•\s+", "")
    listed = docs.select(key, F.split(flat, r"\s+").alias("_words")).withColumn("_stems", stem_all(plain))
    hit = F.transform("_stems", lambda s: s.isin(stems or [""]))
    at = F.greatest(F.array_position(hit, True).cast("int") - 5, F.lit(0))
    listed = listed.withColumn("_at", F.coalesce(at, F.lit(0)))
    marked = F.transform(
        F.arrays_zip(F.slice("_words", F.col("_at") + 1, size).alias("w"), F.slice("_stems", F.col("_at") + 1, size).alias("s")),
        lambda x: F.when(x["s"].isin(stems or [""]), F.concat(F.lit("<mark>"), x["w"], F.lit("</mark>"))).otherwise(x["w"]),
    )
    text = F.concat(
        F.when(F.col("_at") > 0, "...").otherwise(""), F.array_join(marked, " "),
        F.when(F.col("_at") + size < F.size("_words"), "...").otherwise(""),
    )
    return listed.select(key, text.alias("snippet"))


def highlight_stems(c: Column, stems: list[str], words: list[str] | None = None, mark: tuple[str, str] = ("<mark>", "</mark>")) -> Column:
    """Words whose stem, or which themselves, are looked for, in marks; everything else stays."""
    parts = F.regexp_extract_all(c, F.lit(f"({WORD}|[^\\p{{L}}\\p{{N}}]+)"), F.lit(1))
    stemmed = stem_all(F.transform(parts, lambda p: F.lower(p)))
    hit = lambda x: x["s"].isin(stems or [""]) | F.lower(x["p"]).isin(words or [""])
    out = F.transform(
        F.arrays_zip(parts.alias("p"), stemmed.alias("s")),
        lambda x: F.when(hit(x), F.concat(F.lit(mark[0]), x["p"], F.lit(mark[1]))).otherwise(x["p"]),
    )
    return F.array_join(out, "")


def section_excerpts(docs: DataFrame, query: str, body: str = "body", key: str = "doc_id", config: AnalyzerConfig | None = None) -> DataFrame:
    """``doc_id, line, section, is_bullet, excerpt``: lines with a match, under the latest
    heading of ``#`` marks above them ("Document Overview" before the first)."""
    stems, raw = query_stems(query, config), query.lower().split()
    lines = docs.select(key, F.posexplode(F.split(body, "\n")).alias("line", "raw")).withColumn("raw", trimmed(F.col("raw")))
    heading = F.when(F.col("raw").rlike(r"^#{1,6}\s+"), F.regexp_replace("raw", r"^#{1,6}\s+", ""))
    above = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.where("raw <> ''").withColumn("_h", heading).withColumn(
        "section", F.coalesce(F.last("_h", ignorenulls=True).over(above), F.lit("Document Overview"))
    )
    matched = (
        placed.where("_h is null")
        .withColumn("_words", _words_of(F.col("raw")))
        .withColumn("_stems", stem_all(F.col("_words")))
        .where(_both(F.col("_stems"), F.col("_words"), stems, raw) > 0)
    )
    return matched.select(
        key, "line", "section", F.col("raw").rlike(r"^(• |[-*+]\s+)").alias("is_bullet"),
        F.regexp_replace("raw", r"^(•|[-*+])\s+", "").alias("excerpt"),
    )


def split_notes(docs: DataFrame, title: str = "title", body: str = "body", key: str = "doc_id") -> DataFrame:
    """``doc_id, part, title, body``: notes parted by lines of three dashes, blank parts left
    out; the title is the first heading, else the note's title with the part's number."""
    parts = F.filter(F.transform(F.split(F.col(body), r"\r?\n---\r?\n"), trimmed), lambda p: F.length(p) > 0)
    each = docs.select(key, F.col(title).alias("_title"), F.posexplode(parts).alias("_at", "body"))
    heading = trimmed(F.regexp_extract("body", r"^#+\s*([^\n]+)", 1))
    named = F.when(F.length("_title") > 0, F.concat("_title", F.lit(" (Part "), F.col("_at") + 1, F.lit(")")))
    numbered = F.concat(F.lit("Document #"), F.col("_at") + 1)
    return each.select(
        key, (F.col("_at") + 1).alias("part"), F.when(heading != "", heading).otherwise(F.coalesce(named, numbered)).alias("title"), "body"
    )


def explain_words(query: str, config: AnalyzerConfig | None = None) -> list[tuple[str, str, bool]]:
    """``(word, stem, is stop word)`` of each word of a query."""
    import regex

    config = config or AnalyzerConfig()
    return [(w, normalize_term(w, config), w.lower() in config.words()) for w in regex.findall(WORD, query)]


def explain_table(queries: DataFrame, text: str = "text", config: AnalyzerConfig | None = None) -> DataFrame:
    """``word, stem, is_stop_word`` of every word of a table of queries, by place."""
    config = config or AnalyzerConfig()
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    each = queries.select("*", F.posexplode(words).alias("at", "word"))
    lower = F.lower(strip_diacritics(F.col("word")))
    return each.select(*queries.columns, "at", "word", stem_word(lower).alias("stem"), lower.isin(sorted(config.words())).alias("is_stop_word"))


def filter_documents(docs: DataFrame, needle: str, columns: tuple[str, ...] = ("title", "path")) -> DataFrame:
    """Documents whose title or path holds a text, in any case."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False))
    return docs.where(out)


def footprint(index: Index) -> DataFrame:
    """``terms, postings, positions, characters``: what an index holds."""
    p = index.postings.agg(F.count("*").alias("postings"), F.sum("tf").cast("long").alias("positions")).withColumn("_one", F.lit(1))
    t = index.terms.agg(F.count("*").alias("terms"), F.sum(F.length("term")).cast("long").alias("characters")).withColumn("_one", F.lit(1))
    return t.join(p, "_one").drop("_one")


def text_counts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, characters, words, lines`` of each text; a null one has none."""
    c = F.coalesce(F.col(text), F.lit(""))
    words = F.size(F.regexp_extract_all(c, F.lit(r"([^ \t\n\r\f\x0b]+)"), F.lit(1)))
    return docs.select(key, F.length(c).alias("characters"), words.alias("words"), F.when(c == "", 0).otherwise(F.size(F.split(c, "\n"))).alias("lines"))


def flatten_json(c: Column) -> Column:
    """A JSON object as lines ``key: value``, in its order; other values as they are."""
    pairs = F.map_entries(F.from_json(c, "map<string,string>"))
    lines = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")
    return F.coalesce(F.when(F.size(pairs) > 0, lines), c)


def markdown_title(body: Column, otherwise: Column) -> Column:
    """The first heading of one ``#``, else ``otherwise``."""
    title = F.trim(F.regexp_extract(body, r"(?m)^#\s+(.+)$", 1))
    return F.when(title != "", title).otherwise(otherwise)


def nearest_rank(df: DataFrame, value: str, quantiles: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Percentiles by nearest rank (the value at ``floor(n * q)`` from 0), and least and most,
    of each group, or of all rows. Nulls don't count."""
    by = by or []
    whole = df.where(F.col(value).isNotNull()).select(F.struct(F.lit(0).alias("_all"), *by).alias("_key"), value)
    placed = ranked(whole, ["_key"], [value], "_at")
    ends = placed.groupBy("_key").agg(F.count("*").alias("_n"), F.min(value).alias("min"), F.max(value).alias("max"))
    ends = ends.select(F.col("_key").alias("_of"), "_n", "min", "max")
    both = placed.join(ends, F.col("_key").eqNullSafe(F.col("_of")))
    at = {name: F.least(F.floor(F.col("_n") * q), F.col("_n") - 1) for name, q in quantiles.items()}
    picks = [F.max(F.when(F.col("_at") == k, F.col(value))).alias(name) for name, k in at.items()]
    out = both.groupBy("_key").agg(F.first("min").alias("min"), F.first("max").alias("max"), *picks)
    return out.select(*(F.col("_key")[b].alias(b) for b in by), "min", "max", *quantiles)


def without_samples(docs: DataFrame, paths: frozenset[str] = frozenset(), kinds: tuple[str, ...] = ("Technical Paper",)) -> DataFrame:
    """Stored documents without samples: those flagged ``is_sample``, of one of ``kinds`` or under one
    of ``paths``; columns that are missing, and nulls, say nothing."""
    sample = F.lit(False)
    for name, condition in (
        ("is_sample", lambda c: c), ("doc_type", lambda c: c.isin(list(kinds))), ("path", lambda c: c.isin(sorted(paths)) if paths else F.lit(False)),
    ):
        if name in docs.columns:
            sample = sample | F.coalesce(condition(F.col(name)), F.lit(False))
    return docs.where(~sample)


def envelope(query: str, rows: list, milliseconds: float) -> str:
    """A result as JSON: the query, how many rows were returned, the time, and the rows."""
    shown = [r.asDict(recursive=True) for r in rows]
    return json.dumps({"query": query, "totalResults": len(shown), "executionTimeMs": round(milliseconds, 2), "results": shown}, ensure_ascii=False)
