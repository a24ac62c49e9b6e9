import os

from textloom.engine import SearchEngine
from textloom.functions.analysis import AnalyzerConfig
from textloom.operators.index import build_index, merged, without
from textloom.plans import search as plans
from textloom.sources import storage

DOCS = [(1, "alpha beta"), (2, "alpha alpha gamma"), (3, "beta gamma delta"), (4, None), (5, "delta")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def found(index, query):
    return [(r.doc_id, round(r.score, 9)) for r in plans.search(index, query, highlight=False).collect()]


def test_segments_equal_one_index(spark):
    config = AnalyzerConfig(stemming=False)
    whole = build_index(frame(spark, DOCS), config)
    parts = merged(build_index(frame(spark, DOCS[:2]), config), build_index(frame(spark, DOCS[2:]), config))
    for query in ("alpha OR delta", "gamma", '"beta gamma"', "NOT alpha AND delta", "alp*", "gammo"):
        assert found(parts, query) == found(whole, query)
    assert sorted(map(tuple, parts.terms.collect())) == sorted(map(tuple, whole.terms.collect()))
    less = without(whole, frame(spark, [(2, None), (9, None), (2, None), (None, None)]))
    rest = build_index(frame(spark, [d for d in DOCS if d[0] != 2]), config)
    assert sorted(map(tuple, less.terms.collect())) == sorted(map(tuple, rest.terms.collect()))
    assert found(less, "alpha OR gamma") == found(rest, "alpha OR gamma")


def test_engine_updates_without_rebuilding(spark, tmp_path):
    engine = SearchEngine(spark, f"{tmp_path}/i", stemming=False).add_documents(frame(spark, DOCS))
    first = engine.index
    engine.add_documents(frame(spark, [(6, "alpha epsilon")]))
    assert {r.doc_id for r in engine.search("alpha").collect()} == {1, 2, 6} and engine._index.docs is not first.docs
    engine.upsert(frame(spark, [(1, "zeta"), (7, "zeta")])).delete(frame(spark, [(2, None)]))
    assert {r.doc_id for r in engine.search("alpha").collect()} == {6} and {r.doc_id for r in engine.search("zeta").collect()} == {1, 7}
    for k in range(10, 20):
        engine.add_document(k, text=f"alpha w{k}")
        engine.index
    assert engine._segments <= 8 and engine.search("alpha", limit=None).count() == 11
    engine.commit()
    loaded = SearchEngine.load(spark, f"{tmp_path}/i")
    assert loaded.search("alpha", limit=None).count() == 11 and loaded.stats().first() == engine.stats().first()
    engine.clear()
    assert engine.search("alpha").count() == 0


def test_saves_keep_one_run_before_the_latest(spark, tmp_path):
    index = build_index(frame(spark, DOCS))
    for _ in range(3):
        storage.save(index, f"{tmp_path}/i")
    runs = [n for n in os.listdir(f"{tmp_path}/i") if len(n) == 32]
    assert len(runs) == 2 and not any("_unsorted" in os.listdir(f"{tmp_path}/i/{n}") for n in runs)
    assert storage.load(spark, f"{tmp_path}/i").docs.count() == 5


def test_many_queries_equal_single_ones(spark):
    index = build_index(frame(spark, DOCS), AnalyzerConfig(stemming=False)).checkpointed()
    queries = ["alpha", "alpha AND beta", "alpha OR delta NOT beta", '"beta gamma"', '"alpha gamma"', "gam*", "delt~2", "alphq", "NOT alpha", "the", "(alpha OR beta) AND (gamma OR delta)", '"alpha"', "a*"]
    many = {k: q for k, q in enumerate(queries * 40)}
    rows = {}
    for r in plans.search_batch(index, many, digits=9).collect():
        rows.setdefault(r.qid, []).append((r.rank, r.doc_id, r.score, tuple(r.matched_terms)))
    for k, q in enumerate(queries):
        one = [(n, r.doc_id, r.score, tuple(r.matched_terms)) for n, r in enumerate(plans.search_batch(index, {0: q}, digits=9).collect(), 1)]
        for copy in range(k, len(many), len(queries)):
            assert sorted(rows.get(copy, [])) == one, q
    named = plans.search_batch(index, {"x": "alpha", "y": "beta"}).collect()
    assert {r.qid for r in named} == {"x", "y"} and plans.search_batch(index, {"z": "alpha"}).first().qid == "z"
