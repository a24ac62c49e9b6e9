"""Queries of the engine over the test tables, and the SQL that states the same results.

Words are searched in the unstemmed index where SQL states the result, as no SQL dialect has
this stemmer; the stemmed paths are tested with fixed pairs and run here without SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.engine import SearchEngine
from textloom.functions import analysis, codecs
from textloom.functions.analysis import AnalyzerConfig
from textloom.functions.register import register
from textloom.functions.words import STOP_WORDS
from textloom.operators import index as tables, ranking, variants
from textloom.operators.numbering import numbered
from textloom.plans import search as plans
from textloom.plans.language import Phrase
from textloom.plans.session import scratch, spread, table
from textloom.sources import files, storage
from textloom.sources.readable import readable
from textloom.stems_sql import stems
from textloom.streaming import log

PLAIN = AnalyzerConfig(stemming=False)
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Distinct records of indexable_docs, one per id."""
    t = table(spark, d, "indexable_docs").select("doc_id", "title", "body", "text", "category", "path")
    return t.where("doc_id is not null").dropDuplicates(["doc_id"])


_SAVED: dict[tuple, tables.Index] = {}


def _index(spark: SparkSession, d: str, config: AnalyzerConfig = PLAIN) -> tables.Index:
    """The index of the documents, saved as an engine would once for each session and folder, and
    loaded again: all searches run on its files."""
    key = (spark.sparkContext.applicationId, d, config)
    if key not in _SAVED:
        built = tables.build_index(_documents(spark, d), config, text=F.col("text"), check=False)
        _SAVED[key] = storage.load(spark, storage.save(built, scratch(spark)))
    return _SAVED[key]


# SQL building blocks --------------------------------------------------------------------

_STOP = "(" + ", ".join(f"'{w}'" for w in sorted(STOP_WORDS)) + ")"
_BAG_STOP = "(" + ", ".join(f"'{w}'" for w in sorted(variants.BAG_STOP_WORDS)) + ")"
#: Compatibility forms in the texts that ``strip_accents`` leaves: the lunate sigma and two spaces.
_FOLD = "lower(strip_accents(translate(text, 'ϲ' || chr(160) || chr(8195), 'ς  ')))"
_WORDS = rf"""w0 AS (SELECT doc_id, coalesce({_FOLD}, '') AS f FROM documents WHERE doc_id IS NOT NULL),
w1 AS (SELECT doc_id, unnest(regexp_extract_all(f, '[\p{{L}}\p{{N}}_]+')) AS term,
  generate_subscripts(regexp_extract_all(f, '[\p{{L}}\p{{N}}_]+'), 1) AS k FROM w0)"""
_TOKENS = rf"""{_WORDS},
tok AS (SELECT doc_id, term, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS position
  FROM w1 WHERE length(term) BETWEEN 1 AND 64 AND term NOT IN {_STOP})"""
_TABLES = rf"""{_TOKENS},
post AS (SELECT term, doc_id, count(*)::INT AS tf, list(position ORDER BY position) AS positions FROM tok GROUP BY term, doc_id),
len AS (SELECT d.doc_id, coalesce(t.n, 0)::INT AS length FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id) t USING (doc_id)),
lex AS (SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS ttf FROM post GROUP BY term),
st AS (SELECT count(*)::DOUBLE AS n, avg(length) AS a FROM len)"""


_STEMMED = f"""{_TOKENS}, {stems("(SELECT term AS word FROM tok)")}"""
#: Tables of the stemmed index, as those of the plain one.
_STEM_TABLES = f"""{_STEMMED}, stok AS (SELECT t.doc_id, s.stem AS term, t.position FROM tok t JOIN stems s ON s.word = t.term),
post AS (SELECT term, doc_id, count(*)::INT AS tf, list(position ORDER BY position) AS positions FROM stok GROUP BY term, doc_id),
len AS (SELECT d.doc_id, coalesce(t.n, 0)::INT AS length FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM stok GROUP BY doc_id) t USING (doc_id)),
lex AS (SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS ttf FROM post GROUP BY term),
st AS (SELECT count(*)::DOUBLE AS n, avg(length) AS a FROM len)"""


def _bm25_sql(terms: str, k1: float = 1.2, b: float = 0.75) -> str:
    """``s(doc_id, score)``: summed BM25 of ``terms``, a subquery (term, weight)."""
    return f"""s AS (SELECT p.doc_id, sum(q.weight * ln((st.n - x.df + 0.5) / (x.df + 0.5) + 1) * (p.tf * ({k1} + 1)) /
  (p.tf + {k1} * (1 - {b} + {b} * l.length / st.a))) AS score, list(p.term) AS found
  FROM post p JOIN ({terms}) q USING (term) JOIN lex x USING (term) JOIN len l ON l.doc_id = p.doc_id, st GROUP BY p.doc_id)"""


def _terms_sql(*terms: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{t}', 1)" for t in terms) + ") v(term, weight)"


def _top_sql(where: str = "TRUE", limit: int = 20) -> str:
    return f"SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0 AND {where} ORDER BY round(score, 6) DESC, doc_id LIMIT {limit}"


def _found(index: tables.Index, query, limit: int | None = 20, **options) -> DataFrame:
    hits = plans.search_batch(index, {0: query}, limit=limit, digits=6, **options)
    return hits.select("doc_id", "score")


# Text analysis --------------------------------------------------------------------------


@_query("SELECT doc_id, regexp_replace(body, '<[^>]*>', ' ', 'g') AS plain FROM (SELECT DISTINCT doc_id, body FROM indexable_docs) WHERE body IS NOT NULL")
def strip_html_bodies(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "indexable_docs").select("doc_id", "body").distinct().where("body is not null")
    return docs.select("doc_id", analysis.strip_html(F.col("body")).alias("plain"))


_LEFT = "CASE " + " ".join(
    f"WHEN regexp_matches(x, '(?i)^<({'|'.join(names.split())})[^>]*>') THEN '{left}'" for left, names in files.ELEMENT_LEAVES.items()
) + " WHEN regexp_matches(x, '(?i)^<(style|script)[^>]*>') THEN '' ELSE x END"
_HTML_SQL = rf"""WITH b AS (SELECT DISTINCT doc_id, title, body AS c FROM indexable_docs WHERE body IS NOT NULL),
t AS (SELECT *, array_to_string(list_transform(regexp_extract_all(c, '{files.HTML_PIECES}'), lambda x: {_LEFT}), '') AS x FROM b),
u AS (SELECT *, array_to_string(list_transform(string_split(regexp_replace(x, '<[^>]+>', ' ', 'g'), chr(10)),
  lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), chr(10)) AS l FROM t),
v AS (SELECT *, regexp_replace(regexp_replace(l, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS y FROM u)
SELECT doc_id, coalesce(nullif(trim(regexp_extract(c, '{files.PAGE_TITLE}', 1)), ''), title) AS title,
 CASE WHEN y <> '' THEN y ELSE c END AS readable FROM v"""


@_query(_HTML_SQL)
def html_clean_bodies(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "indexable_docs").select("doc_id", "title", "body").distinct().where("body is not null")
    return docs.select(
        "doc_id", files.html_title(F.col("body"), F.col("title")).alias("title"), files.html_text(F.col("body")).alias("readable")
    )


@_query(f"SELECT doc_id, {_FOLD} AS folded FROM documents")
def fold_text(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", analysis.filter_chars(F.col("text"), PLAIN).alias("folded"))


@_query(f"SELECT doc_id, {_FOLD} AS folded FROM documents WHERE text IS NOT NULL")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The registered functions in a SQL statement."""
    register(spark)
    return spark.sql("SELECT doc_id, fold(text) AS folded FROM {docs} WHERE text IS NOT NULL", docs=_documents(spark, d))


@_query(f"WITH {_TOKENS} SELECT doc_id, term, position FROM tok")
def tokenize_table_function(spark: SparkSession, d: str) -> DataFrame:
    register(spark, PLAIN)
    sql = "SELECT d.doc_id, t.term, t.position FROM {docs} d, LATERAL tokenize(d.text) t"
    return spark.sql(sql, docs=_documents(spark, d))


@_query(
    rf"""WITH n AS (SELECT doc_id, lower(array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '(?s).'),
  lambda c: CASE WHEN c = 'ϲ' THEN 'ς' WHEN strip_accents(c) <> c THEN strip_accents(c) || ' ' ELSE c END), '')) AS f FROM documents),
b AS (SELECT doc_id, list_filter(regexp_extract_all(f, '[\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 2 AND x NOT IN {_BAG_STOP}) AS w FROM n),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM b), {stems("u")}
SELECT n.doc_id, coalesce(l.stems, []) AS stems FROM n LEFT JOIN (SELECT doc_id, list(stem ORDER BY k) AS stems FROM u JOIN stems USING (word) GROUP BY doc_id) l
  ON l.doc_id = n.doc_id"""
)
def bag_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Stems of the bag modes: marks part words, single characters are dropped."""
    return _documents(spark, d).select("doc_id", variants.bag_tokens(F.col("text"), 2).alias("stems"))


@_query("SELECT DISTINCT doc_id FROM indexable_docs WHERE coalesce(title, '') <> '' OR coalesce(body, '') <> ''")
def bulk_import(spark: SparkSession, d: str) -> DataFrame:
    """Records that a bulk import keeps: those with a title or a body."""
    return files.imported(_records(spark, d)).select("doc_id")


@_query(f"WITH {_TOKENS} SELECT doc_id, term, position FROM tok")
def tokenize_positions(spark: SparkSession, d: str) -> DataFrame:
    listed = _documents(spark, d).where("doc_id is not null").select("doc_id", analysis.tokens(F.col("text"), PLAIN).alias("t"))
    return listed.select("doc_id", F.posexplode("t").alias("position", "term")).select("doc_id", "term", "position")


@_query(
    "WITH w0 AS (SELECT doc_id, coalesce(" + _FOLD + r""", '') AS f FROM documents),
g AS (SELECT doc_id, unnest(regexp_extract_all(f, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')) AS run,
  generate_subscripts(regexp_extract_all(f, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), 1) AS k FROM w0),
z AS (SELECT *, octet_length(encode(run)) AS bytes, length(run) + length(regexp_replace(run, '[^\x{10000}-\x{10ffff}]', '', 'g')) AS units FROM g),
o AS (SELECT *, sum(units) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM z)
SELECT doc_id, run AS term, (upto - units)::INT AS start_offset, upto::INT AS end_offset FROM o
WHERE regexp_matches(run, '^[\p{L}\p{N}_]') AND units <= 64 AND run NOT IN """
    + _STOP
)
def token_offsets(spark: SparkSession, d: str) -> DataFrame:
    listed = _documents(spark, d).select("doc_id", F.explode(analysis.analyze(F.col("text"), PLAIN)).alias("t"))
    return listed.select("doc_id", "t.term", "t.start_offset", "t.end_offset")


def _counted(spark: SparkSession, d: str, config: AnalyzerConfig) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.size(analysis.tokens(F.col("text"), config)).alias("n"))


def _counted_sql(where: str) -> str:
    return f"""WITH {_WORDS}, t AS (SELECT doc_id, count(*)::INT AS n FROM w1 WHERE {where} GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n, 0)::INT AS n FROM documents d LEFT JOIN t USING (doc_id)"""


@_query(_counted_sql("length(term) BETWEEN 3 AND 8"))
def token_length_bounds(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d, AnalyzerConfig.of(stemming=False, stop_words=False, min_token_length=3, max_token_length=8))


@_query(_counted_sql(f"length(term) <= 64 AND term NOT IN {_STOP}"))
def stopword_filter_default(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d, PLAIN)


@_query(_counted_sql("length(term) <= 64 AND term NOT IN ('index', 'segment', 'the')"))
def stopword_filter_custom(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d, AnalyzerConfig.of(stemming=False, stop_words=["Index", "segment", "THE"]))


@_query(_counted_sql("length(term) <= 64"))
def stopword_filter_off(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d, AnalyzerConfig.of(stemming=False, stop_words=False))


@_query(f"WITH {_STEMMED} SELECT word, stem FROM stems")
def stem_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    words = _documents(spark, d).select(F.explode(analysis.tokens(F.col("text"), PLAIN)).alias("word")).distinct()
    return words.select("word", analysis.stem_word(F.col("word")).alias("stem"))


@_query(
    f"""WITH g AS (SELECT term_id, lower(strip_accents(term)) AS word FROM glossary), {stems("g")}
SELECT term_id, stem AS form FROM g JOIN stems USING (word)"""
)
def normalize_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "glossary").select("term_id", "term")
    return terms.select("term_id", analysis.stem_word(F.lower(analysis.strip_diacritics(F.col("term")))).alias("form"))


_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")


@_query(
    rf"""WITH r AS (SELECT DISTINCT doc_id, options_id, CASE WHEN text IS NOT NULL THEN text WHEN coalesce(title, '') <> '' OR coalesce(body, '') <> ''
  THEN concat_ws(' ', nullif(title, ''), nullif(body, '')) ELSE concat_ws(' ', title, body, text) END AS c FROM indexable_docs WHERE doc_id IS NOT NULL),
o AS (SELECT r.*, coalesce(a.lowercase, TRUE) AS low, coalesce(a.strip_html, FALSE) AS tags, coalesce(a.strip_diacritics, TRUE) AS marks,
  coalesce(a.stop_words, 'default') AS stop, coalesce(a.min_token_length, 1) AS least, coalesce(a.max_token_length, 64) AS most FROM r LEFT JOIN analyzer_options a USING (options_id)),
h AS (SELECT *, CASE WHEN tags THEN regexp_replace(c, '<[^>]*>', ' ', 'g') ELSE c END AS h FROM o),
m AS (SELECT *, CASE WHEN marks THEN strip_accents(replace(replace(replace(translate(h, 'ϲ{_WIDE}', 'ς{_NARROW}'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl')) ELSE h END AS m FROM h),
f AS (SELECT *, CASE WHEN low THEN lower(m) ELSE m END AS f FROM m),
w AS (SELECT *, list_filter(regexp_extract_all(f, '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) BETWEEN least AND most) AS w FROM f)
SELECT doc_id, options_id, len(CASE WHEN stop IN ('none', 'off') THEN w WHEN stop = 'default' THEN list_filter(w, lambda x: x NOT IN {_STOP})
  ELSE list_filter(w, lambda x: NOT list_contains(regexp_extract_all(lower(stop), '[^\s,;|]+'), x)) END)::INT AS n FROM w"""
)
def analyze_by_options(spark: SparkSession, d: str) -> DataFrame:
    """Token counts of each record under the options that it names, or the defaults where it names
    none or unknown ones; one branch per options row (a table of settings), all over one scan.
    ``stop_words`` is 'default', 'off' or a list of words."""
    known = table(spark, d, "analyzer_options").where("options_id is not null").dropDuplicates(["options_id"]).limit(_MOST_OPTIONS + 1).collect()
    if len(known) > _MOST_OPTIONS:
        raise ValueError(f"more than {_MOST_OPTIONS} rows of options")
    records = table(spark, d, "indexable_docs").select("doc_id", "title", "body", "text", "options_id").where("doc_id is not null").dropDuplicates(["doc_id"])
    text = analysis.text_of([("title", "string"), ("body", "string"), ("text", "string")])
    parts = [(F.coalesce(~F.col("options_id").isin([o["options_id"] for o in known]), F.lit(True)), AnalyzerConfig())]
    for o in known:
        stop = o["stop_words"] or "default"
        words = stop == "default" if stop in ("default", "none", "off") else frozenset(w for w in re.split(r"[\s,;|]+", stop.lower()) if w)
        config = AnalyzerConfig(
            o["lowercase"] is not False, bool(o["strip_html"]), o["strip_diacritics"] is not False, words, bool(o["stemming"]),
            1 if o["min_token_length"] is None else o["min_token_length"], 64 if o["max_token_length"] is None else o["max_token_length"],
        )
        parts.append((F.col("options_id") == o["options_id"], config))
    each = [records.where(c).select("doc_id", "options_id", F.size(analysis.tokens(text, replace(x, stemming=False))).alias("n")) for c, x in parts]
    return reduce(DataFrame.unionByName, each)


#: Most rows of the options table that plans are made for.
_MOST_OPTIONS = 1000


@_query("SELECT p_partkey, concat_ws(' ', nullif(p_name, ''), nullif(p_type, '')) AS content FROM part")
def extract_text_title_body(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_type").alias("body"))
    return part.select("p_partkey", analysis.text_of(part.dtypes, "p_partkey").alias("content"))


@_query("SELECT c_custkey, concat_ws(' ', c_name, c_mktsegment) AS content FROM customer")
def extract_text_fallback(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer")
    return customer.select("c_custkey", analysis.text_of(customer.dtypes, "c_custkey").alias("content"))


@_query(
    """SELECT DISTINCT doc_id, CASE WHEN text IS NOT NULL THEN text WHEN coalesce(title, '') <> '' OR coalesce(body, '') <> ''
THEN concat_ws(' ', nullif(title, ''), nullif(body, '')) ELSE concat_ws(' ', title, body, text) END AS content FROM indexable_docs"""
)
def extract_text_records(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "indexable_docs").select("doc_id", "title", "body", "text").distinct()
    return t.select("doc_id", analysis.text_of(t.dtypes, "doc_id").alias("content"))


# Index build ----------------------------------------------------------------------------


@_query(f"WITH {_TABLES} SELECT term, doc_id, tf, positions FROM post")
def build_postings(spark: SparkSession, d: str) -> DataFrame:
    index = tables.build_index(_documents(spark, d), PLAIN, text=F.col("text"), check=False)
    return index.postings.select("term", "doc_id", "tf", "positions")


@_query(f"WITH {_TABLES} SELECT term, df, ttf FROM lex")
def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return tables.build_index(_documents(spark, d), PLAIN, text=F.col("text"), check=False).terms


@_query(f"WITH {_TABLES} SELECT doc_id, length FROM len")
def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return tables.build_index(_documents(spark, d), PLAIN, text=F.col("text"), check=False).docs.select("doc_id", "length")


@_query(
    f"""WITH {_TABLES} SELECT (SELECT count(*) FROM len)::BIGINT AS total_documents, (SELECT count(*) FROM lex)::BIGINT AS total_terms,
(SELECT sum(length) FROM len)::BIGINT AS total_tokens, (SELECT round(avg(length), 6) FROM len) AS average_doc_length"""
)
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = _index(spark, d).stats()
    return stats.withColumn("average_doc_length", F.round("average_doc_length", 6))


@_query(
    """WITH p AS (SELECT DISTINCT term, doc_id FROM postings WHERE term IS NOT NULL AND doc_id IS NOT NULL),
r AS (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1 AS at, floor(sqrt(count(*) OVER (PARTITION BY term)))::INT AS step FROM p)
SELECT a.term, a.at::INT AS posting_index, b.at::INT AS target_index, b.doc_id AS target_doc_id FROM r a JOIN r b ON a.term = b.term AND b.at = a.at + a.step
WHERE a.step > 1 AND a.at % a.step = 0"""
)
def skip_pointers(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "postings").where("term is not null and doc_id is not null").select("term", "doc_id").distinct()
    return tables.skip_pointers(p)


@_query(f"WITH {_TABLES} SELECT term, df, ttf FROM lex ORDER BY term")
def lexicon_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Every term in order."""
    return tables.lexicon_sorted(_index(spark, d))


@_query(
    """WITH t AS (SELECT DISTINCT doc_id, term, position FROM tokens WHERE term IS NOT NULL AND doc_id IS NOT NULL AND position IS NOT NULL)
SELECT term, doc_id, count(*)::INT AS tf, list(position ORDER BY position) AS positions FROM t GROUP BY term, doc_id"""
)
def postings_from_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Postings of a token table whose rows may repeat or come late."""
    t = table(spark, d, "tokens").select("doc_id", "term", "position").dropna().distinct()
    grouped = t.groupBy("term", "doc_id").agg(F.sort_array(F.collect_list("position")).alias("positions"))
    return grouped.select("term", "doc_id", F.size("positions").alias("tf"), "positions")


@_query("SELECT doc_id, max(length)::INT AS length, max(segment_id)::INT AS segment_id FROM indexed_docs WHERE doc_id IS NOT NULL GROUP BY doc_id")
def merged_documents(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "indexed_docs").where("doc_id is not null")
    return t.groupBy("doc_id").agg(F.max("length").alias("length"), F.max("segment_id").alias("segment_id"))


@_query("SELECT term, sum(df)::BIGINT AS df, sum(ttf)::BIGINT AS ttf, count(DISTINCT segment_id)::BIGINT AS segments FROM lexicon GROUP BY term")
def merged_lexicon(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lexicon")
    return t.groupBy("term").agg(
        F.sum("df").cast("long").alias("df"), F.sum("ttf").cast("long").alias("ttf"), F.count_distinct("segment_id").alias("segments")
    )


# Sets of documents and lexicon lookups --------------------------------------------------


@_query(f"WITH {_TABLES} SELECT doc_id, tf, positions FROM post WHERE term = 'segment'")
def term_lookup(spark: SparkSession, d: str) -> DataFrame:
    return tables.postings_of(_index(spark, d), "Segment").select("doc_id", "tf", "positions")


@_query(f"WITH {_TABLES} SELECT a.doc_id FROM post a JOIN post b USING (doc_id) WHERE a.term = 'segment' AND b.term = 'index'")
def bag_and(spark: SparkSession, d: str) -> DataFrame:
    return plans.boolean_and(_index(spark, d), ["segment", "index"])


@_query(f"WITH {_TABLES} SELECT DISTINCT doc_id FROM post WHERE term IN ('cipher', 'bitmap')")
def bag_or(spark: SparkSession, d: str) -> DataFrame:
    return plans.boolean_or(_index(spark, d), ["cipher", "bitmap", "notinthere"])


@_query(f"WITH {_TABLES} SELECT doc_id FROM len WHERE doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'index')")
def bool_not(spark: SparkSession, d: str) -> DataFrame:
    return plans.matching(_index(spark, d), "NOT index")


_HAS = "doc_id IN (SELECT doc_id FROM post WHERE term = '{}')"


@_query(
    f"""WITH {_TABLES} SELECT doc_id FROM len WHERE ({_HAS.format("cipher")} OR {_HAS.format("index")}) AND {_HAS.format("segment")}
AND NOT {_HAS.format("cache")}"""
)
def bool_complex(spark: SparkSession, d: str) -> DataFrame:
    return plans.matching(_index(spark, d), "(cipher OR index) AND segment NOT cache")


@_query(f"WITH {_TABLES} SELECT a.doc_id FROM (SELECT doc_id FROM post WHERE term = 'cache') a JOIN (SELECT doc_id FROM post WHERE term = 'shard') b USING (doc_id)")
def intersect_sets(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    docs = lambda t: index.postings.where(F.col("term") == t).select("doc_id")
    return docs("cache").intersect(docs("shard"))


@_query(f"WITH {_TABLES} SELECT term, df, ttf FROM lex WHERE starts_with(term, 'compa')")
def prefix_terms(spark: SparkSession, d: str) -> DataFrame:
    return plans.prefix_terms(_index(spark, d), "Compa")


@_query(f"WITH {_TABLES} SELECT DISTINCT doc_id FROM post WHERE starts_with(term, 'norma')")
def prefix_search(spark: SparkSession, d: str) -> DataFrame:
    return plans.matching(_index(spark, d), "norma*")


@_query(f"WITH {_TABLES} SELECT term, df FROM lex WHERE starts_with(term, 'co') ORDER BY df DESC, term LIMIT 5")
def suggest(spark: SparkSession, d: str) -> DataFrame:
    return plans.suggest(_index(spark, d), "CO")


@_query(f"WITH {_TABLES} SELECT term, df, ttf, levenshtein(term, 'indxe')::INT AS distance FROM lex WHERE levenshtein(term, 'indxe') <= 2")
def fuzzy_terms(spark: SparkSession, d: str) -> DataFrame:
    return plans.fuzzy_terms(_index(spark, d), "indxe", 2)


@_query(f"WITH {_TABLES} SELECT DISTINCT doc_id FROM post WHERE levenshtein(term, 'ciphr') <= 1")
def fuzzy_docs(spark: SparkSession, d: str) -> DataFrame:
    return plans.matching(_index(spark, d), "ciphr~1")


@_query(
    f"""WITH {_TABLES}, n AS (SELECT term, levenshtein(term, 'segmemt') AS e FROM lex WHERE levenshtein(term, 'segmemt') <= 2),
c AS (SELECT term FROM n WHERE e = (SELECT min(e) FROM n) ORDER BY term LIMIT 3)
SELECT DISTINCT doc_id FROM post JOIN c USING (term)"""
)
def auto_fuzzy_fallback(spark: SparkSession, d: str) -> DataFrame:
    return plans.matching(_index(spark, d), "segmemt")


_PAIR = """SELECT a.doc_id, a.position FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.position {} WHERE a.term = 'posting' AND b.term = 'list'"""


@_query(f"WITH {_TABLES} SELECT DISTINCT doc_id FROM ({_PAIR.format('= a.position + 1')})")
def phrase_exact(spark: SparkSession, d: str) -> DataFrame:
    return plans.matching(_index(spark, d), '"posting list"')


@_query(f"WITH {_TABLES} SELECT doc_id, list(position ORDER BY position) AS match_positions FROM ({_PAIR.format('= a.position + 1')}) GROUP BY doc_id")
def phrase_positions(spark: SparkSession, d: str) -> DataFrame:
    return plans.phrase_matches(_index(spark, d), "Posting list")


@_query(
    f"""WITH {_TABLES}, p AS (SELECT DISTINCT a.doc_id, a.position FROM tok a JOIN tok b ON a.doc_id = b.doc_id
AND b.position BETWEEN a.position + 1 AND a.position + 4 WHERE a.term = 'readers' AND b.term = 'confuse')
SELECT doc_id, list(position ORDER BY position) AS match_positions FROM p GROUP BY doc_id"""
)
def phrase_slop(spark: SparkSession, d: str) -> DataFrame:
    return plans.phrase_matches(_index(spark, d), "readers confuse", slop=3)


@_query(
    f"""WITH {_TABLES}, a AS (SELECT doc_id, position FROM tok WHERE term = 'readers'),
b AS (SELECT a.doc_id, a.position, min(t.position) AS p2 FROM a JOIN tok t ON t.doc_id = a.doc_id AND t.term = 'confuse' AND t.position BETWEEN a.position + 1 AND a.position + 6 GROUP BY ALL),
c AS (SELECT b.doc_id, b.position, min(t.position) AS p3 FROM b JOIN tok t ON t.doc_id = b.doc_id AND t.term = 'differ' AND t.position BETWEEN b.p2 + 1 AND b.p2 + 6 GROUP BY b.doc_id, b.position, b.p2)
SELECT DISTINCT doc_id FROM c"""
)
def phrase_slop_three(spark: SparkSession, d: str) -> DataFrame:
    return plans.matching(_index(spark, d), Phrase(("readers", "confuse", "differ"), 5))


# Ranked search --------------------------------------------------------------------------


@_query(f"WITH {_TABLES}, {_bm25_sql(_terms_sql('segment'))} {_top_sql()}")
def bm25_single(spark: SparkSession, d: str) -> DataFrame:
    return _found(_index(spark, d), "segment")


@_query(f"WITH {_TABLES}, {_bm25_sql(_terms_sql('segment', 'index'))} {_top_sql('len(found) = 2')}")
def bm25_and(spark: SparkSession, d: str) -> DataFrame:
    return _found(_index(spark, d), "segment AND index")


@_query(f"WITH {_TABLES}, {_bm25_sql(_terms_sql('cipher', 'bitmap'))} {_top_sql()}")
def bm25_or(spark: SparkSession, d: str) -> DataFrame:
    return _found(_index(spark, d), "cipher || bitmap")


@_query(
    f"""WITH {_TABLES}, {_bm25_sql(_terms_sql('posting', 'list'))}, ph AS (SELECT DISTINCT doc_id FROM ({_PAIR.format('= a.position + 1')}))
{_top_sql('doc_id IN (SELECT doc_id FROM ph)')}"""
)
def bm25_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _found(_index(spark, d), '"posting list"')


@_query(f"WITH {_TABLES}, {_bm25_sql('SELECT term, 1 AS weight FROM lex WHERE starts_with(term, $$compa$$)')} {_top_sql()}")
def bm25_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _found(_index(spark, d), "compa*")


_COMPLEX = "(segment OR cache) AND index NOT cipher"


@_query(
    f"""WITH {_TABLES}, {_bm25_sql(_terms_sql('segment', 'cache', 'index'))}
{_top_sql("list_contains(found, 'index') AND len(found) >= 2 AND doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'cipher')")}"""
)
def bm25_complex(spark: SparkSession, d: str) -> DataFrame:
    return _found(_index(spark, d), _COMPLEX)


@_query(f"WITH {_TABLES}, {_bm25_sql(_terms_sql('segment', 'index'), 2.0, 0.3)} {_top_sql()}")
def bm25_params(spark: SparkSession, d: str) -> DataFrame:
    return _found(_index(spark, d), "segment OR index", k1=2.0, b=0.3)


@_query(f"WITH {_TABLES}, {_bm25_sql(_terms_sql('segment'))} {_top_sql()} OFFSET 100000000")
def pure_not_finds_nothing(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a scoring word are never returned, so NOT alone finds none."""
    return _found(_index(spark, d), "NOT segment")


@_query(f"WITH {_TABLES}, {_bm25_sql('SELECT term, 2 AS weight FROM lex WHERE term = $$segment$$')} {_top_sql()}")
def duplicate_word_weight(spark: SparkSession, d: str) -> DataFrame:
    """Two spellings that stand for one term score it twice."""
    return _found(_index(spark, d), "segment OR Segment")


@_query(
    f"""WITH {_TABLES}, s AS (SELECT p.doc_id, sum(p.tf / l.length * ln(1 + st.n / x.df)) AS score FROM post p JOIN lex x USING (term)
JOIN len l ON l.doc_id = p.doc_id, st WHERE p.term IN ('segment', 'index') GROUP BY p.doc_id) {_top_sql()}"""
)
def tfidf_rank(spark: SparkSession, d: str) -> DataFrame:
    return _found(_index(spark, d), "segment OR index", scorer="tfidf")


@_query(f"WITH {_TABLES}, {_bm25_sql(_terms_sql('cipher', 'bitmap', 'varint'))} {_top_sql(limit=10)}")
def wand_topk_equiv(spark: SparkSession, d: str) -> DataFrame:
    return plans.wand(_index(spark, d), ["cipher", "bitmap", "varint"], 10, digits=6).select("doc_id", "score")


@_query()
def stemmed_search(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d, AnalyzerConfig())
    return plans.search(index, 'segments AND "posting lists" OR compac*', limit=20, digits=6)


@_query(
    f"""WITH {_STEM_TABLES}, {_bm25_sql(_terms_sql("segment", "post", "list"))},
ph AS (SELECT DISTINCT a.doc_id FROM stok a JOIN stok b ON a.doc_id = b.doc_id AND b.position = a.position + 1 WHERE a.term = 'post' AND b.term = 'list')
{_top_sql("list_contains(found, 'segment') AND doc_id IN (SELECT doc_id FROM ph)")}"""
)
def stemmed_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _found(_index(spark, d, AnalyzerConfig()), 'segments AND "posting lists"')


@_query(f"WITH {_STEM_TABLES} SELECT term, df, ttf FROM lex")
def stemmed_lexicon(spark: SparkSession, d: str) -> DataFrame:
    """The lexicon alone of a saved index."""
    return _index(spark, d, AnalyzerConfig()).terms


@_query(f"WITH {_STEM_TABLES} SELECT DISTINCT doc_id FROM post WHERE term = 'compact'")
def stop_word_in_boolean(spark: SparkSession, d: str) -> DataFrame:
    """A stop word isn't in the lexicon, so OR finds what the other word finds."""
    return plans.matching(_index(spark, d, AnalyzerConfig()), "the OR compacting", fuzzy=False)


@_query()
def highlight_terms(spark: SparkSession, d: str) -> DataFrame:
    return plans.search(_index(spark, d), "segment AND index", limit=20, digits=6).select("doc_id", "snippet")


_BATCH = {"cache": "cache", "pair": "segment AND index", "any": "cipher OR bitmap"}


@_query(
    f"""WITH {_TABLES}, q AS (SELECT * FROM (VALUES ('cache', 'cache', 1), ('pair', 'segment', 2), ('pair', 'index', 2), ('any', 'cipher', 1), ('any', 'bitmap', 1)) v(qid, term, need)),
s AS (SELECT q.qid, p.doc_id, sum(ln((st.n - x.df + 0.5) / (x.df + 0.5) + 1) * (p.tf * 2.2) / (p.tf + 1.2 * (0.25 + 0.75 * l.length / st.a))) AS score, count(*) AS k, min(q.need) AS need
  FROM post p JOIN q USING (term) JOIN lex x USING (term) JOIN len l ON l.doc_id = p.doc_id, st GROUP BY q.qid, p.doc_id),
r AS (SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM s WHERE k >= need)
SELECT qid, doc_id, score, rank FROM r WHERE rank <= 10"""
)
def batch_search(spark: SparkSession, d: str) -> DataFrame:
    return plans.search_batch(_index(spark, d), _BATCH, limit=10, digits=6).select("qid", "doc_id", "score", "rank")


# Codecs, storage ------------------------------------------------------------------------


@_query("SELECT DISTINCT term, doc_id, CASE WHEN list_sum(list_transform(positions, lambda p: p)) IS NULL THEN positions ELSE list_transform(list_zip(positions, list_prepend(0, positions[:-2])), lambda z: z[1] - z[2])::BIGINT[] END AS deltas FROM postings WHERE positions IS NOT NULL")
def delta_encode(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "postings").where("positions is not null").select("term", "doc_id", "positions").distinct()
    return p.select("term", "doc_id", codecs.encode_deltas(F.col("positions")).alias("deltas"))


@_query("SELECT DISTINCT term, doc_id, positions::BIGINT[] AS positions FROM postings WHERE positions IS NOT NULL")
def delta_decode(spark: SparkSession, d: str) -> DataFrame:
    coded = delta_encode(spark, d)
    return coded.select("term", "doc_id", codecs.decode_deltas(F.col("deltas")).alias("positions"))


@_query(
    """SELECT o_orderkey, (1 + (o_orderkey >= 128)::INT + (o_orderkey >= 16384)::INT + (o_orderkey >= 2097152)::INT + (o_orderkey >= 268435456)::INT)::INT AS size FROM orders"""
)
def varint_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", codecs.varint_size(F.col("o_orderkey")).alias("size"))


@_query(
    """WITH k AS (SELECT o_orderkey, o_orderkey & 4294967295 AS n FROM orders), g AS (SELECT *, list_transform([0, 7, 14, 21, 28], lambda i: (n >> i) & 127) AS p,
  CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 WHEN n < 2097152 THEN 3 WHEN n < 268435456 THEN 4 ELSE 5 END AS size FROM k)
SELECT o_orderkey, list_aggregate(list_transform(range(1, size + 1), lambda i: printf('%02X', p[i] + CASE WHEN i < size THEN 128 ELSE 0 END)), 'string_agg', '') AS code FROM g"""
)
def varint_encode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.hex(codecs.encode_varint(F.col("o_orderkey"))).alias("code"))


@_query("SELECT DISTINCT term, doc_id, positions::BIGINT[] AS positions FROM postings WHERE positions IS NOT NULL")
def varint_decode(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "postings").where("positions is not null").select("term", "doc_id", "positions").distinct()
    coded = p.select("term", "doc_id", codecs.encode_varints(F.col("positions")).alias("bytes"))
    return coded.select("term", "doc_id", codecs.decode_varints(F.col("bytes")).alias("positions"))


@_query()
def compression_ratio(spark: SparkSession, d: str) -> DataFrame:
    return storage.compression(_index(spark, d))


@_query(f"WITH {_TABLES} SELECT doc_id, tf, positions FROM post WHERE term = 'bitmap'")
def saved_term(spark: SparkSession, d: str) -> DataFrame:
    """Save an index, commit it by its configuration file, and read one term's postings alone."""
    built = tables.build_index(_documents(spark, d), PLAIN, text=F.col("text"), check=False)
    return storage.read_term(spark, storage.save(built, scratch(spark)), "bitmap").select("doc_id", "tf", "positions")


@_query(
    f"""WITH {_TABLES} SELECT (SELECT count(*) FROM len)::BIGINT AS total_documents, (SELECT count(*) FROM lex)::BIGINT AS total_terms,
(SELECT sum(length) FROM len)::BIGINT AS total_tokens, (SELECT round(avg(length), 6) FROM len) AS average_doc_length"""
)
def saved_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The statistics row alone of an index that an engine has committed."""
    path = SearchEngine(spark, scratch(spark), stemming=False).add_documents(_documents(spark, d)).commit()
    return storage.read_stats(spark, path).withColumn("average_doc_length", F.round("average_doc_length", 6))


@_query(f"WITH {_TABLES} SELECT term, df, ttf FROM lex")
def saved_lexicon(spark: SparkSession, d: str) -> DataFrame:
    path = storage.save(tables.build_index(_documents(spark, d), PLAIN, text=F.col("text"), check=False), scratch(spark))
    return storage.read_lexicon(spark, path)


@_query(f"WITH {_TABLES} SELECT doc_id, text, length FROM len JOIN documents USING (doc_id)")
def loaded_documents(spark: SparkSession, d: str) -> DataFrame:
    """Stored documents of an index that was saved and loaded."""
    return tables.all_documents(_index(spark, d)).select("doc_id", "text", "length")


@_query(
    """SELECT DISTINCT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'replaced' ELSE text END AS text, title, body FROM indexable_docs
WHERE doc_id IS NOT NULL AND doc_id % 5 <> 0"""
)
def engine_updates(spark: SparkSession, d: str) -> DataFrame:
    """Documents of an engine after a batch, a replacement and a deletion, each a segment."""
    docs = _records(spark, d).select("doc_id", "title", "body", "text")
    engine = SearchEngine(spark).add_documents(docs)
    engine.index
    engine.upsert(docs.where("doc_id % 2 = 0").withColumn("text", F.lit("replaced"))).delete(docs.where("doc_id % 5 = 0"))
    return engine.documents().select("doc_id", "text", "title", "body")


@_query("SELECT DISTINCT doc_id, title, body, text FROM indexable_docs WHERE doc_id IS NOT NULL")
def log_file_replay(spark: SparkSession, d: str) -> DataFrame:
    """Records written to the log twice and read again from its files: each comes once."""
    folder, docs = scratch(spark), _records(spark, d)
    log.append(docs, folder)
    log.append(docs.select("doc_id", F.lit("later").alias("title")), folder)
    return log.replay(log.read(spark, folder)).select("doc_id", "title", "body", "text")


@_query("SELECT count(*) AS entries FROM documents WHERE false")
def log_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """Nothing is left to replay once the log was emptied."""
    folder = scratch(spark)
    log.append(_documents(spark, d), folder)
    log.checkpoint(spark, folder)
    return log.read(spark, folder).agg(F.count("*").alias("entries"))


@_query(f"WITH {_TABLES} SELECT term, df, ttf FROM lex")
def streamed_lexicon(spark: SparkSession, d: str) -> DataFrame:
    """The lexicon after two batches of the log came through the stream."""
    folder, target, state = scratch(spark), scratch(spark), scratch(spark)
    for rest in (0, 1):
        log.append(_documents(spark, d).where((F.col("doc_id") % 2 == rest) & F.col("text").isNotNull()), folder)
        log.ingest_stream(spark, folder, target, state, PLAIN).awaitTermination()
    return log.live_index(spark, target, PLAIN).terms


@_query("SELECT row_number() OVER (ORDER BY doc_id)::BIGINT AS doc_id, doc_id || '.md' AS title, coalesce(text, '') AS body FROM documents")
def uploaded_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts uploaded as files; ids count on in the order of the names, here of equal length."""
    docs = _documents(spark, d).select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name"), "text", "doc_id")
    out = files.uploaded(docs.select(F.concat("name", F.lit(".md")).alias("name"), F.col("text").alias("content")))
    return out.select("doc_id", F.ltrim("title", F.lit("0")).alias("title"), "body")


@_query("SELECT row_number() OVER (ORDER BY event_id)::BIGINT AS doc_id, lpad(event_id::VARCHAR, 12, '0') || '.json' AS title, json_extract_string(props, '$.k') AS k FROM events WHERE props IS NOT NULL")
def uploaded_json(spark: SparkSession, d: str) -> DataFrame:
    """JSON objects uploaded as files; keys that are no field of a document are kept as extra."""
    docs = table(spark, d, "events").where("props is not null").select(
        F.concat(F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit(".json")).alias("name"), F.col("props").alias("content")
    )
    out = files.uploaded(docs)
    return out.select("doc_id", F.col("path").alias("title"), F.get_json_object("extra", "$.k").alias("k"))


# The log, updates -----------------------------------------------------------------------


def _entries(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "log_entries")
    place = F.struct("ts", "sequence_number", F.coalesce(F.col("payload.text"), F.lit("")).alias("text"))
    return t.select(F.col("sequence_number").alias("sequenceNumber"), F.col("entry_type").alias("type"), "payload", place.alias("place"))


@_query(
    """WITH e AS (SELECT payload.id AS doc_id, payload.text AS text, row_number() OVER (PARTITION BY payload.id ORDER BY ts, sequence_number, coalesce(payload.text, '')) AS k
FROM log_entries WHERE entry_type = 'INSERT' AND payload IS NOT NULL AND payload.id IS NOT NULL) SELECT doc_id, text FROM e WHERE k = 1"""
)
def log_replay_dedup(spark: SparkSession, d: str) -> DataFrame:
    return log.replay(_entries(spark, d))


@_query(
    """SELECT DISTINCT payload.id AS doc_id FROM log_entries WHERE entry_type = 'INSERT' AND payload.id IS NOT NULL
AND payload.id NOT IN (SELECT doc_id FROM indexable_docs WHERE category IS NOT NULL AND doc_id IS NOT NULL)"""
)
def log_recover(spark: SparkSession, d: str) -> DataFrame:
    """What is to be added to an index that holds the records with a category."""
    held = table(spark, d, "indexable_docs").where("category is not null").select("doc_id").distinct()
    return log.replay(_entries(spark, d), held).select("doc_id")


@_query(
    f"""WITH {_TABLES}, old AS (SELECT p.term, count(*)::BIGINT AS df FROM post p JOIN documents USING (doc_id) WHERE lang = 'en' GROUP BY p.term),
new AS (SELECT p.term, count(*)::BIGINT AS df FROM post p JOIN documents USING (doc_id) WHERE lang IS DISTINCT FROM 'en' GROUP BY p.term)
SELECT term, (coalesce(old.df, 0) + coalesce(new.df, 0))::BIGINT AS df FROM old FULL JOIN new USING (term)"""
)
def incremental_stats(spark: SparkSession, d: str) -> DataFrame:
    """Frequencies after a second batch is appended to the first."""
    docs = table(spark, d, "documents")
    part = lambda c: tables.build_index(docs.where(c).select("doc_id", "text"), PLAIN, text=F.col("text"), check=False).postings
    both = part(F.col("lang") == "en").unionByName(part(~F.col("lang").eqNullSafe("en")))
    return tables.term_stats(both).select("term", "df")


@_query(
    """SELECT doc_id, 'changed' AS text FROM labels WHERE quality = 1 AND doc_id IS NOT NULL UNION ALL
SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IN (1, 5) AND doc_id IS NOT NULL)"""
)
def upsert_delete(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").where("doc_id is not null")
    changed = labels.where("quality = 1").select("doc_id", F.lit("changed").alias("text"))
    kept = tables.delete(_documents(spark, d), labels.where("quality = 5").select("doc_id"))
    return tables.upsert(kept, changed)


@_query("SELECT doc_id, row_number() OVER (ORDER BY path NULLS LAST, doc_id)::BIGINT AS number FROM documents")
def number_documents(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of all documents, those without a path last."""
    docs = table(spark, d, "documents").select("doc_id", "path")
    return numbered(docs, [F.col("path").asc_nulls_last(), "doc_id"]).select("doc_id", "number")


@_query("SELECT event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_payload(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


# Other search and display modes ---------------------------------------------------------

_BAG = f"""WITH {_TABLES}, b AS (SELECT p.doc_id, count(*)::BIGINT AS matched, sum(ln((st.n - x.df + 0.5) / (x.df + 0.5) + 1) * (p.tf * 2.2) / (p.tf + 1.2 * (0.25 + 0.75 * l.length / st.a))) AS raw
FROM post p JOIN lex x USING (term) JOIN len l ON l.doc_id = p.doc_id, st WHERE p.term IN ('segment', 'index', 'cache') {{}} GROUP BY p.doc_id)"""


@_query(
    _BAG.replace("{}", "")
    + " SELECT doc_id, matched, round(CASE WHEN matched = 3 THEN raw * 1.35 ELSE raw END, 2) AS score FROM b WHERE matched >= 2 ORDER BY score DESC, doc_id LIMIT 15"
)
def min_should_match_boost(spark: SparkSession, d: str) -> DataFrame:
    return variants.bag_search(_index(spark, d), "segment index cache").select("doc_id", "matched", "score")


@_query(
    _BAG.replace("{}", "AND p.doc_id IN (SELECT doc_id FROM documents WHERE source LIKE 'forum%')")
    + " SELECT doc_id, matched, round(raw, 2) AS score FROM b ORDER BY score DESC, doc_id LIMIT 15"
)
def corpus_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    index = tables.build_index(docs, PLAIN, text=F.col("text"), check=False).checkpointed()
    return variants.bag_search(index, "segment OR index OR cache", where=F.col("source").startswith("forum")).select("doc_id", "matched", "score")


@_query()
def score_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return variants.bag_search(_index(spark, d), "segment index cache")


@_query(
    rf"""WITH d AS (SELECT doc_id, path, regexp_replace(regexp_replace(coalesce(text, ''), '###\s+', '', 'g'), '•\s+', '', 'g') AS flat FROM documents),
e AS (SELECT doc_id, regexp_replace(flat, '([.!?\n])\s+', '\1' || chr(1), 'g') AS flat FROM d),
p AS (SELECT doc_id, list_filter(list_transform(string_split(flat, chr(1)), lambda x: regexp_replace(x, '^[\s\p{{Z}}\x{{FEFF}}]+|[\s\p{{Z}}\x{{FEFF}}]+$', '', 'g')), lambda x: length(x) > 0) AS p FROM e),
s AS (SELECT doc_id, unnest(p) AS sentence, generate_subscripts(p, 1) AS k FROM p),
w AS (SELECT doc_id, k, sentence, unnest(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}]+')) AS word FROM s), {stems("w")},
h AS (SELECT doc_id, k, sentence, count(*) AS n FROM w JOIN stems USING (word) WHERE word IN ('cipher', 'bitmap') OR stem IN ('cipher', 'bitmap') GROUP BY doc_id, k, sentence),
b AS (SELECT doc_id, arg_max(sentence, n * 100000 - k) AS best, sum(n)::BIGINT AS match_count FROM h GROUP BY doc_id),
x AS (SELECT *, string_split_regex(best, '\s+') AS parts FROM b),
y AS (SELECT *, greatest(list_position(list_transform(parts, lambda w: regexp_matches(regexp_replace(lower(w), '[^\p{{L}}\p{{N}}]', '', 'g'), '^(cipher|bitmap)(s|ed|ing)?$')), TRUE) - 1, 0) AS m FROM x),
z AS (SELECT *, greatest(m - 5, 0) AS a, least(m + 16, len(parts)) AS o FROM y)
SELECT d.doc_id, CASE WHEN best IS NULL THEN regexp_replace(left(flat, 130), '^[\s\p{{Z}}\x{{FEFF}}]+|[\s\p{{Z}}\x{{FEFF}}]+$', '', 'g') || CASE WHEN length(flat) > 130 THEN ' …' ELSE '' END
  WHEN length(best) <= 180 THEN best ELSE CASE WHEN a > 0 THEN '… ' ELSE '' END || array_to_string(parts[a + 1:o], ' ') || CASE WHEN o < len(parts) THEN ' …' ELSE '' END END AS snippet,
 coalesce(match_count, 0)::BIGINT AS match_count, CASE WHEN best IS NULL THEN 'none' ELSE 'body' END AS place FROM d LEFT JOIN z USING (doc_id)"""
)
def sentence_snippet(spark: SparkSession, d: str) -> DataFrame:
    return variants.sentence_snippets(_documents(spark, d), "cipher, bitmap", body="text", config=PLAIN)


@_query()
def readable_documents(spark: SparkSession, d: str) -> DataFrame:
    """Title, text and kind of each body, whatever its path says."""
    return readable(_records(spark, d).where("body is not null"), "doc_id", F.col("body"), F.lit(""))


@_query(
    "SELECT DISTINCT doc_id FROM indexable_docs WHERE doc_id IS NOT NULL AND category IS DISTINCT FROM 'query' AND NOT coalesce(path LIKE 'tutorial/%', FALSE)"
)
def restored_documents(spark: SparkSession, d: str) -> DataFrame:
    """Stored documents after a start, samples purged by flag and kind."""
    docs = _records(spark, d).select("doc_id", F.col("category").alias("doc_type"), F.col("path").startswith("tutorial/").alias("is_sample"))
    return variants.without_samples(docs, kinds=("query",)).select("doc_id")


@_query(
    rf"""WITH d AS (SELECT doc_id, string_split_regex(regexp_replace(regexp_replace(text, '###\s+', '', 'g'), '•\s+', '', 'g'), '\s+') AS words FROM documents),
u AS (SELECT doc_id, unnest(words) AS shown, generate_subscripts(words, 1) AS k FROM d), v AS (SELECT *, regexp_replace(lower(shown), '[^\w]', '', 'g') AS word FROM u), {stems("v")},
h AS (SELECT v.*, stem IN ('cipher', 'bitmap') AS hit FROM v JOIN stems USING (word)),
f AS (SELECT doc_id, greatest(coalesce(min(k) FILTER (hit), 0) - 5, 0) AS a, max(k) AS n FROM h GROUP BY doc_id),
t AS (SELECT h.doc_id, any_value(f.a) AS a, any_value(f.n) AS n, string_agg(CASE WHEN hit THEN '<mark>' || shown || '</mark>' ELSE shown END, ' ' ORDER BY k) AS t
  FROM h JOIN f USING (doc_id) WHERE k > f.a AND k <= f.a + 28 GROUP BY h.doc_id)
SELECT d.doc_id, CASE WHEN a > 0 THEN '...' ELSE '' END || t || CASE WHEN a + 28 < n THEN '...' ELSE '' END AS snippet FROM d LEFT JOIN t USING (doc_id)"""
)
def window_snippet(spark: SparkSession, d: str) -> DataFrame:
    return variants.window_snippets(_documents(spark, d), "cipher bitmap", body="text", config=PLAIN)


@_query(
    rf"""WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+') AS p FROM documents),
u AS (SELECT doc_id, unnest(p) AS shown, generate_subscripts(p, 1) AS k FROM p), w AS (SELECT *, lower(shown) AS word FROM u), {stems("w")},
m AS (SELECT doc_id, string_agg(CASE WHEN stem IN ('segment', 'indic') THEN '<mark>' || shown || '</mark>' ELSE shown END, '' ORDER BY k) AS marked FROM w JOIN stems USING (word) GROUP BY doc_id)
SELECT p.doc_id, CASE WHEN p.text IS NOT NULL THEN coalesce(m.marked, '') END AS marked FROM p LEFT JOIN m USING (doc_id)"""
)
def highlight_by_stem(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", variants.highlight_stems(F.col("text"), ["segment", "indic"]).alias("marked"))


@_query(
    rf"""WITH r AS (SELECT DISTINCT doc_id, body FROM indexable_docs WHERE doc_id IS NOT NULL AND body IS NOT NULL),
l AS (SELECT doc_id, regexp_replace(unnest(string_split(body, chr(10))), '^[\s\p{{Z}}\x{{FEFF}}]+|[\s\p{{Z}}\x{{FEFF}}]+$', '', 'g') AS raw, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS line FROM r),
h AS (SELECT *, CASE WHEN regexp_matches(raw, '^#{{1,6}}\s+') THEN regexp_replace(raw, '^#{{1,6}}\s+', '') END AS h FROM l WHERE raw <> ''),
s AS (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING), 'Document Overview') AS section FROM h),
w AS (SELECT doc_id, line, unnest(regexp_extract_all(lower(raw), '[\p{{L}}\p{{N}}]+')) AS word FROM s WHERE h IS NULL), {stems("w")},
m AS (SELECT DISTINCT doc_id, line FROM w JOIN stems USING (word) WHERE word IN ('segment', 'index') OR stem IN ('segment', 'index'))
SELECT doc_id, line::INT AS line, section, regexp_matches(raw, '^(• |[-*+]\s+)') AS is_bullet, regexp_replace(raw, '^(•|[-*+])\s+', '') AS excerpt FROM s JOIN m USING (doc_id, line)"""
)
def section_excerpts(spark: SparkSession, d: str) -> DataFrame:
    return variants.section_excerpts(_records(spark, d), "segment index")


@_query(
    r"""WITH r AS (SELECT DISTINCT doc_id, title, body FROM indexable_docs WHERE doc_id IS NOT NULL AND body IS NOT NULL),
p AS (SELECT doc_id, title, list_filter(list_transform(string_split_regex(body, '\r?\n---\r?\n'), lambda x: regexp_replace(x, '^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$', '', 'g')), lambda x: length(x) > 0) AS p FROM r),
e AS (SELECT doc_id, title, unnest(p) AS body, generate_subscripts(p, 1) AS part FROM p), h AS (SELECT *, regexp_replace(regexp_extract(body, '^#+\s*([^\n]+)', 1), '^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$', '', 'g') AS h FROM e)
SELECT doc_id, part::INT AS part, CASE WHEN h <> '' THEN h WHEN length(title) > 0 THEN title || ' (Part ' || part || ')' ELSE 'Document #' || part END AS title, body FROM h"""
)
def note_split(spark: SparkSession, d: str) -> DataFrame:
    return variants.split_notes(_records(spark, d))


@_query(
    rf"""WITH g AS (SELECT term_id, term, unnest(regexp_extract_all(term, '[\p{{L}}\p{{N}}]+')) AS shown,
  generate_subscripts(regexp_extract_all(term, '[\p{{L}}\p{{N}}]+'), 1) - 1 AS "at" FROM glossary), w AS (SELECT *, lower(strip_accents(shown)) AS word FROM g), {stems("w")}
SELECT term_id, term, CAST("at" AS INT) AS "at", shown AS word, stem, word IN {_STOP} AS is_stop_word FROM w JOIN stems USING (word)"""
)
def query_explain(spark: SparkSession, d: str) -> DataFrame:
    return variants.explain_table(table(spark, d, "glossary").select("term_id", "term"), "term")


@_query("SELECT DISTINCT doc_id FROM indexable_docs WHERE contains(lower(title), 'handbook') OR contains(lower(path), 'handbook')")
def document_list_filter(spark: SparkSession, d: str) -> DataFrame:
    return variants.filter_documents(_records(spark, d), "HANDBOOK").select("doc_id")


@_query(f"WITH {_TABLES} SELECT (SELECT count(*) FROM lex)::BIGINT AS terms, (SELECT sum(length(term)) FROM lex)::BIGINT AS characters, (SELECT count(*) FROM post)::BIGINT AS postings, (SELECT sum(tf) FROM post)::BIGINT AS positions")
def index_footprint(spark: SparkSession, d: str) -> DataFrame:
    return variants.footprint(_index(spark, d))


@_query(
    r"""SELECT doc_id, length(coalesce(text, ''))::INT AS characters, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\v]+'))::INT AS words,
CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, E'\n')) END::INT AS lines FROM documents"""
)
def text_counts(spark: SparkSession, d: str) -> DataFrame:
    return variants.text_counts(_documents(spark, d))


@_query("SELECT count(*)::BIGINT AS documents, count_if(text IS NULL)::BIGINT AS empty, count_if(lang = 'en')::BIGINT AS english FROM documents")
def corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.agg(F.count("*").alias("documents"), F.count_if(F.col("text").isNull()).alias("empty"), F.count_if(F.col("lang") == "en").alias("english"))


@_query("SELECT event_id, 'k: ' || json_extract_string(props, '$.k') AS body FROM events WHERE props IS NOT NULL")
def json_flatten(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("props is not null").select("event_id", variants.flatten_json(F.col("props")).alias("body"))


@_query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, min(value) AS min, max(value) AS max, max(value) FILTER (k = floor(n * 0.5)) AS median, max(value) FILTER (k = floor(n * 0.95)) AS p95, max(value) FILTER (k = floor(n * 0.99)) AS p99
FROM r GROUP BY event_type"""
)
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return variants.nearest_rank(table(spark, d, "events"), "value", {"median": 0.5, "p95": 0.95, "p99": 0.99}, ["event_type"])


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return bm25_complex(spark, d)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
