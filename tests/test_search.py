import math

import pytest
from pyspark.sql import functions as F

from textloom.functions.analysis import AnalyzerConfig
from textloom.operators import index as tables, ranking
from textloom.operators.index import DuplicateIds, build_index
from textloom.plans import search as plans
from textloom.plans.language import Phrase

DOCS = [
    (1, "Distributed Consensus", "Paxos and Raft are consensus algorithms with fault tolerance."),
    (2, "Databases", "Distributed databases enable distributed consensus. Storage engine postings."),
    (3, "Café algorithms", "Byzantine fault tolerance algorithms for blockchain."),
    (4, None, None),
]


@pytest.fixture(scope="module")
def index(spark):
    return build_index(spark.createDataFrame(DOCS, "doc_id long, title string, body string")).checkpointed()


def ids(df):
    return [r.doc_id for r in df.collect()]


@pytest.mark.parametrize(
    ("query", "found"),
    [
        ("consensus", {1, 2}), ('algorithms AND "fault tolerance"', {1, 3}), ("algorithms NOT blockchain", {1}), ("distrib*", {1, 2}),
        ("distributed*", set()), ("postngs", {2}), ("algoritm~2", {1, 3}), ("is consensus", set()), ("NOT consensus", set()), ("a AND", set()),
        ("consensus OR", {1, 2}), ("blockchain OR NOT consensus", {3}), ("café", {3}), ("", set()), ('"the of"', set()),
        ('"tolerance fault"', set()), ("(distributed OR paxos) AND consensus NOT storage", {1}), ("blockchan", {3}), ("xq", set()),
    ],
)
def test_queries(index, query, found):
    assert set(ids(plans.search(index, query))) == found


def test_fuzzy_off(index):
    assert ids(plans.search(index, "postngs", fuzzy=False)) == []


def test_scores_and_double_weight(index):
    one = {r.doc_id: r.score for r in plans.search(index, "distributed", highlight=False).collect()}
    two = {r.doc_id: r.score for r in plans.search(index, "distributed distribution", highlight=False).collect()}
    assert two == pytest.approx({k: 2 * v for k, v in one.items()})
    lengths = [r.length for r in index.docs.collect()]
    average = sum(lengths) / len(lengths)
    idf = math.log((4 - 2 + 0.5) / (2 + 0.5) + 1)
    length = next(r.length for r in index.docs.collect() if r.doc_id == 1)
    assert one[1] == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / average)))


def test_matched_terms_in_query_order_and_snippet(index):
    row = plans.search(index, 'tolerance "fault tolerance" byzan*').first()
    assert row.doc_id == 3 and row.matched_terms[:2] == ["tolerance", "fault"] and "byzantin" in row.matched_terms
    assert "**fault**" in row.snippet and "**tolerance**" in row.snippet


def test_limit_below_one_keeps_a_row(index):
    assert len(ids(plans.search(index, "consensus", limit=0))) == 1


def test_batch(index):
    rows = plans.search_batch(index, {"x": "consensus", "y": "fault NOT raft", "none": "zzzzzzzz"}).collect()
    assert {(r.qid, r.doc_id) for r in rows} == {("x", 1), ("x", 2), ("y", 3)}


def test_sets(index):
    assert set(ids(plans.matching(index, "NOT consensus"))) == {3, 4}
    assert ids(plans.boolean_and(index, ["databases", "consensus"])) == [2]
    assert ids(plans.boolean_and(index, ["databases", "missing"])) == []
    assert set(ids(plans.boolean_or(index, ["paxos", "missing", "blockchain"]))) == {1, 3}
    assert ids(plans.boolean_and(index, [])) == []


def test_lexicon(index):
    assert plans.suggest(index, "dist").first().term == "distribut"
    assert plans.suggest(index, "").count() == 0
    assert plans.fuzzy_terms(index, "computr", 2).count() == 0
    assert plans.fuzzy_terms(index, "algoritm", 2).first().term == "algorithm"
    row = index.terms.where("term = 'distribut'").first()
    assert (row.df, row.ttf) == (2, 3)
    assert tables.postings_of(index, "Distributed").count() == 2


def test_stats(index, spark):
    s = index.stats().first()
    assert s.total_documents == 4 and s.average_doc_length == s.total_tokens / 4
    empty = build_index(spark.createDataFrame([], "doc_id long, text string")).stats().first()
    assert tuple(empty) == (0, 0, 0, 0.0)


def test_duplicate_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, text string")
    with pytest.raises(DuplicateIds, match="already exists"):
        build_index(docs)


PLACES = [(1, "aa bb"), (2, "bb aa"), (3, "aa xx yy bb"), (4, "aa bb xx xx xx xx xx xx xx xx aa bb"), (5, "aa xx bb"), (6, "aa bb bb xx cc")]


def test_phrases(spark):
    config = AnalyzerConfig(stemming=False)
    index = build_index(spark.createDataFrame(PLACES, "doc_id long, text string"), config).checkpointed()
    starts = {r.doc_id: r.match_positions for r in plans.phrase_matches(index, "aa bb").collect()}
    assert starts == {1: [0], 4: [0, 10], 6: [0]}
    assert 5 in ids(plans.phrase_matches(index, "aa bb", slop=1)) and 3 not in ids(plans.phrase_matches(index, "aa bb", slop=1))
    # the nearest bb is taken although only the next one has cc close enough
    greedy = build_index(spark.createDataFrame([(1, "aa bb bb xx cc")], "doc_id long, text string"), config).checkpointed()
    assert ids(plans.phrase_matches(greedy, "aa bb cc", slop=1)) == []
    assert ids(plans.matching(index, Phrase(("aa",)))) == [1, 2, 3, 4, 5, 6] or len(ids(plans.matching(index, Phrase(("aa",))))) == 6


def test_skip_pointers(spark):
    rows = [("t", 10 * k) for k in range(16)] + [("u", 1), ("u", 2), ("u", 3)]
    found = tables.skip_pointers(spark.createDataFrame(rows, "term string, doc_id long")).orderBy("posting_index").collect()
    assert [tuple(r)[1:] for r in found] == [(0, 4, 40), (4, 8, 80), (8, 12, 120)]


def test_formulas(spark):
    row = spark.range(1).select(
        ranking.bm25_idf(F.lit(5), F.lit(1000)).alias("rare"), ranking.bm25_idf(F.lit(500), F.lit(1000)).alias("often"),
        ranking.bm25_idf(F.lit(0), F.lit(10)).alias("none"), ranking.tfidf_idf(F.lit(2), F.lit(4)).alias("t"),
        ranking.bm25(F.lit(2), F.lit(10), F.lit(0.0), F.lit(1.0)).alias("flat"),
    ).first()
    assert row.rare > row.often > 0 and row.none == 0 and row.t == pytest.approx(math.log(3)) and row.flat == pytest.approx(4.4 / 3.2)


def test_top_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 5.0)], "doc_id long, score double")
    assert [r.doc_id for r in ranking.top(df, 2).collect()] == [2, 1]
