from pyspark.sql import functions as F

from textloom.functions.analysis import AnalyzerConfig
from textloom.operators import variants
from textloom.operators.index import build_index

DOCS = [(1, "Alpha beta. Beta gamma delta! Other words", True), (2, "alpha only", False), (3, "gamma beta", False), (4, None, True)]


def test_bag_search(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, is_file boolean")
    index = build_index(docs, AnalyzerConfig(stemming=False)).checkpointed()
    both = {r.doc_id: r for r in variants.bag_search(index, "alpha AND beta gamma").collect()}
    assert set(both) == {1, 3} and both[1].matched == 3 and len(both[1].breakdown) == 3 and len(both[1].offsets) <= 4
    assert {r.doc_id for r in variants.bag_search(index, "alpha or gamma").collect()} == {1, 2, 3}
    assert {r.doc_id for r in variants.bag_search(index, "alpha", where=docs.is_file).collect()} == {1}
    assert variants.bag_search(index, "the").count() == 0


def test_excerpts(spark):
    rows = [(1, "T", "Intro beta\n# Head\n- a beta\nnone\n## Two\nbeta end"), (2, "", "---"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, body string")
    out = [tuple(r) for r in variants.section_excerpts(docs, "beta").orderBy("line").collect()]
    assert out == [(1, 0, "Document Overview", False, "Intro beta"), (1, 2, "Head", True, "a beta"), (1, 5, "Two", False, "beta end")]
    s = variants.sentence_snippets(spark.createDataFrame([(1, "No. One beta here. Two beta beta!")], "doc_id long, body string"), "beta").first()
    assert (s.snippet, s.match_count) == ("Two beta beta!", 3)
    w = variants.window_snippets(spark.createDataFrame([(1, "a b c d e f betas g")], "doc_id long, body string"), "beta", size=4).first()
    assert w.snippet == "...c d e f..."


def test_notes_and_counts(spark):
    notes = spark.createDataFrame([(1, "N", "# First\nx\n---\n\n---\nsecond"), (2, None, "only")], "doc_id long, title string, body string")
    out = [tuple(r) for r in variants.split_notes(notes).orderBy("doc_id", "part").collect()]
    assert out == [(1, 1, "First", "# First\nx"), (1, 2, "N (Part 2)", "second"), (2, 1, "Document #1", "only")]
    texts = spark.createDataFrame([(1, "a b\nc"), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in variants.text_counts(texts).orderBy("doc_id").collect()] == [(1, 5, 3, 2), (2, 0, 0, 0), (3, 0, 0, 0)]
    assert variants.explain_words("The Databases") == [("The", "the", True), ("Databases", "databas", False)]


def test_marks_and_percentiles(spark):
    row = spark.createDataFrame([("Indexes, of index!",)], "t string").select(variants.highlight_stems("t", ["index"])).first()
    assert row[0] == "<mark>Indexes</mark>, of <mark>index</mark>!"
    values = spark.createDataFrame([(float(k),) for k in range(100)], "v double")
    r = variants.nearest_rank(values, "v", {"median": 0.5, "p99": 0.99}).first()
    assert (r["min"], r["max"], r["median"], r["p99"]) == (0.0, 99.0, 50.0, 99.0)


def test_bag_tokens(spark):
    row = spark.createDataFrame([("naïve_test a Databases the",)], "t string").select(variants.bag_tokens(F.col("t"), 2).alias("s")).first()
    assert row.s == ["nai", "ve", "test", "databas"]
