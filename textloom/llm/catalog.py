"""Queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.llm import abuse, distinctiveness, encoding, frequencies, markup, near_duplicates, packing, splitting, visual_forms
from textloom.plans.session import spread, table, written


def _rows(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return spread(table(spark, d, name).select(*columns))


_RECORD = ("doc_id", "title", "body", "text", "category", "path", "options_id")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(_rows(spark, d, "indexable_docs", *_RECORD), table(spark, d, "analyzer_options"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.found(p1_pieces(spark, d))


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    return visual_forms.normalise(table(spark, d, "indexable_docs").select("doc_id", "body").distinct())


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    """The form of every distinct term of the archive."""
    terms = table(spark, d, "tokens").select("term").distinct()
    return visual_forms.normalise(terms.withColumn("text", F.col("term")), "term", "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    glossary = table(spark, d, "glossary")
    tokens = visual_forms.disguised(_rows(spark, d, "tokens", "doc_id", "position", "term"), glossary, ["doc_id", "position"], "term", True)
    bodies = visual_forms.disguised(_rows(spark, d, "indexable_docs", "doc_id", "body"), glossary, ["doc_id"], "body", False)
    return (
        tokens.select(F.lit("token").alias("src"), "doc_id", "position", "term_id")
        .unionByName(bodies.select(F.lit("body").alias("src"), "doc_id", F.lit(-1).alias("position"), "term_id"))
        .distinct()
    )


def _deduced(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fields with text, their markup tokens, and the templates deduced from these."""
    pages = markup.fields(_rows(spark, d, "indexable_docs", *_RECORD))
    found = written(markup.tokens(pages))
    return pages, found, written(markup.equivalence_classes(found))


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    pages, found, classes = _deduced(spark, d)
    return markup.cleaned(pages.distinct(), classes, found)


def p3_templates(spark: SparkSession, d: str) -> DataFrame:
    return _deduced(spark, d)[2]


def p3_slots(spark: SparkSession, d: str) -> DataFrame:
    pages, found, classes = _deduced(spark, d)
    return markup.slots(pages.distinct(), classes, found)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    _, found, classes = _deduced(spark, d)
    return markup.kinds(found, classes).select("doc_id", "field", "kind").distinct()


def _similar(spark: SparkSession, d: str) -> near_duplicates.NearDuplicates:
    return near_duplicates.near_duplicates(_rows(spark, d, "indexable_docs", "doc_id", "title", "body"), shingle=3, threshold=0.6, least_words=25)


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.groups(_similar(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.pairs(_similar(spark, d))


def p5_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = distinctiveness.ppmi(table(spark, d, "postings"), table(spark, d, "indexed_docs"))
    return scored.select("doc_id", "term", "tf", "length", "df", F.round("ppmi", 6).alias("ppmi"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    scored = distinctiveness.ppmi(table(spark, d, "postings"), table(spark, d, "indexed_docs"))
    return distinctiveness.marking(scored)


def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    counted = frequencies.value_frequencies(table(spark, d, "postings"))
    return frequencies.marked(counted, table(spark, d, "indexed_docs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_terms(spark, d).where("mark is not null").select("term", "mark")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(_rows(spark, d, "documents", "doc_id", "text"))


def p7_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Ids of each text with the characters that each token spans."""
    return encoding.encode_spans(_rows(spark, d, "documents", "doc_id", "text"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Texts read back from their ids."""
    return encoding.decode(p7_ids(spark, d))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are, and how few there could be at best."""
    return packing.fill(p8_containers(spark, d))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(encoding.token_counts(_rows(spark, d, "documents", "doc_id", "text")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_containers(spark, d).where("piece > 0").select("doc_id").distinct()


def _scored(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    documents = _rows(spark, d, "documents", "doc_id", "text", *keep)
    return abuse.scores(documents, abuse.fit(documents, table(spark, d, "labels")), keep=keep)


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(_scored(spark, d, "source"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where(F.col("score") >= abuse.THRESHOLD).select("doc_id").distinct()


_POSTINGS = """
p AS (SELECT term, doc_id, max(greatest(coalesce(tf, len(positions), 0), 0))::BIGINT AS tf FROM postings
      WHERE term IS NOT NULL AND doc_id IS NOT NULL GROUP BY term, doc_id),
n AS (SELECT count(DISTINCT doc_id) AS n FROM indexed_docs),
s AS (SELECT doc_id, sum(tf)::BIGINT AS total FROM p GROUP BY doc_id),
st AS (SELECT doc_id, max(length)::BIGINT AS stated FROM indexed_docs WHERE doc_id IS NOT NULL GROUP BY doc_id),
l AS (SELECT s.doc_id, coalesce(st.stated, s.total) AS length, s.total FROM s LEFT JOIN st USING (doc_id)),
t AS (SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS ttf FROM p GROUP BY term)"""

_ORACLES = {
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p4_groups": r"""WITH RECURSIVE d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || body), '[\p{L}\p{N}_]+') AS w
  FROM indexable_docs WHERE body IS NOT NULL AND doc_id IS NOT NULL AND len(regexp_extract_all(body, '[\p{L}\p{N}_]+')) >= 25),
s AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) AS t(i)),
n AS (SELECT doc_id, count(*) AS n, list(g ORDER BY g) AS gs FROM s GROUP BY doc_id),
m AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY gs) AS class_id FROM n),
r AS (SELECT s.* FROM s JOIN m USING (doc_id) WHERE m.class_id = m.doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM r a JOIN r b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN m x ON x.doc_id = a JOIN m y ON y.doc_id = b WHERE k / (x.n + y.n - k) >= 0.6),
t AS (SELECT a, b FROM l UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a),
g AS (SELECT a, least(min(b), a) AS g FROM t GROUP BY a), e AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT m.doc_id, m.class_id, coalesce(g.g, m.class_id) AS group_id, coalesce(e.links, 0)::BIGINT AS n_links FROM m LEFT JOIN g ON g.a = m.class_id LEFT JOIN e ON e.a = m.class_id""",
    "p1_found": r"""WITH o AS (SELECT options_id, min(piece_chars) AS c, coalesce(min(max_token_length), 64) AS w
  FROM analyzer_options GROUP BY options_id),
b AS (SELECT DISTINCT doc_id, body, coalesce(o.c, 1200) AS c, coalesce(o.w, 64) AS w
  FROM indexable_docs LEFT JOIN o USING (options_id) WHERE body IS NOT NULL AND doc_id IS NOT NULL),
r AS (SELECT doc_id, w, unnest(regexp_extract_all(body, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')) AS run,
  generate_subscripts(regexp_extract_all(body, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), 1) AS k FROM b),
q AS (SELECT *, sum(length(run)) OVER (PARTITION BY doc_id ORDER BY k) - length(run) AS before FROM r)
SELECT doc_id, 'body' AS kind, 0 AS start_offset FROM b WHERE length(body) > c
UNION SELECT doc_id, 'token', before::INT FROM q WHERE length(run) > w AND regexp_matches(run, '^[\p{L}\p{N}_]')""",
    "p4_found": r"""WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || body), '[\p{L}\p{N}_]+') AS w
  FROM indexable_docs WHERE body IS NOT NULL AND len(regexp_extract_all(body, '[\p{L}\p{N}_]+')) >= 25),
s AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) AS t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT a AS doc_id_a, b AS doc_id_b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k / (x.n + y.n - k) >= 0.6""",
    "p5_scores": f"""WITH {_POSTINGS},
c AS (SELECT sum(pow(length::DOUBLE, 0.75)) AS c FROM l WHERE length > 0)
SELECT p.doc_id, p.term, p.tf, l.length, t.df,
  round(CASE WHEN l.length > 0 AND p.tf > 0 THEN greatest(0.0, ln(p.tf / t.ttf / (pow(l.length::DOUBLE, 0.75) / c.c))) ELSE 0.0 END, 6) AS ppmi
FROM p JOIN t USING (term) JOIN l ON l.doc_id = p.doc_id, c""",
    "p5_found": f"""WITH {_POSTINGS}
SELECT p.doc_id, p.term FROM p JOIN t USING (term) JOIN l ON l.doc_id = p.doc_id, n
WHERE l.length > 0 AND t.df >= 2 AND p.tf / l.length * ln(1 + n.n / t.df) >= 0.25""",
    "p6_terms": f"""WITH {_POSTINGS}
SELECT term, df, ttf, CASE WHEN df <= 2 THEN 'rare' WHEN df > 0.2 * n.n THEN 'common' END AS mark FROM t, n""",
    "p6_found": f"""WITH {_POSTINGS}
SELECT term, CASE WHEN df <= 2 THEN 'rare' ELSE 'common' END AS mark FROM t, n WHERE df <= 2 OR df > 0.2 * n.n""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
