import math
from collections import defaultdict

import pyarrow as pa
from hypothesis import given, settings, strategies as st

from textloom.llm import distinctiveness, frequencies

P = "term string, doc_id long, tf int, positions array<int>, df int, length int"
ROWS = [
    ("the", 1, 2, [0, 1], 9, 9), ("the", 1, 2, None, 9, 9), ("the", 2, 1, None, 9, 9), ("rare", 1, None, [5, 6, 7], 9, 9), ("", 2, 4, None, 9, 9),
    (None, 1, 3, None, 9, 9), ("x", None, 3, None, 9, 9), ("only", 3, 1, [0], 9, 9), ("zero", 4, 0, [], 9, 9),
]
D = [(1, 5, None), (1, 5, 1), (2, None, 1), (5, 0, 1), (None, 3, 1)]


def test_ppmi(spark):
    out = distinctiveness.ppmi(spark.createDataFrame(ROWS, P), spark.createDataFrame(D, "doc_id long, length int, term int"))
    rows = {(r.term, r.doc_id): r for r in out.collect()}
    assert set(rows) == {("the", 1), ("the", 2), ("rare", 1), ("", 2), ("only", 3), ("zero", 4)}
    assert rows["the", 1].n_records == 3 and rows["the", 2].length == 5 and rows["rare", 1].tf == 3 and rows["only", 3].length == 1
    context = {1: 5**0.75, 2: 5**0.75, 3: 1.0}
    expected = math.log(3 / 3 / (context[1] / sum(context.values())))
    assert abs(rows["rare", 1].ppmi - expected) < 1e-9 and rows["zero", 4].ppmi == 0
    assert {tuple(r) for r in distinctiveness.marking(out).collect()} == {(1, "the")}
    empty = spark.createDataFrame([], P)
    assert distinctiveness.ppmi(empty, spark.createDataFrame([], "doc_id long, length int")).count() == 0


def test_frequencies(spark):
    counted = frequencies.value_frequencies(spark.createDataFrame(ROWS, P))
    assert {tuple(r) for r in counted.collect()} == {("the", 2, 3), ("rare", 1, 3), ("", 1, 4), ("only", 1, 1), ("zero", 1, 0)}
    marks = {r.term: r.mark for r in frequencies.marked(counted, spark.createDataFrame(D, "doc_id long, length int, x int"), rare=1, common=0.3).collect()}
    assert marks["the"] == "common" and marks["rare"] == "rare"
    assert frequencies.value_frequencies(spark.createDataFrame([], P)).count() == 0


def test_hot_term_spreads(spark):
    df = spark.range(30_000).selectExpr("if(id % 3 = 0, 'hot', concat('t', id % 500)) as term", "id as doc_id", "1 as tf", "array(1) as positions")
    rows = {r.term: r.df for r in frequencies.value_frequencies(df).collect()}
    assert rows["hot"] == 10_000 and sum(rows.values()) == 30_000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 3), st.integers(0, 4)), max_size=40), st.integers(1, 7))
def test_runs_over_any_batches(rows, size):
    rows.sort()
    schema = pa.schema([("term", pa.string()), ("doc_id", pa.int64()), ("tf", pa.int64())])
    cut = [rows[k : k + size] for k in range(0, len(rows), size)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*c), schema)], schema=schema) for c in cut]
    got: dict = defaultdict(lambda: [0, 0])
    for out in frequencies._runs(iter(batches)):
        for term, df, ttf in zip(*(c.to_pylist() for c in out.columns)):
            got[term][0] += df
            got[term][1] += ttf
    best: dict = {}
    for t, d, n in rows:
        best[t, d] = max(best.get((t, d), 0), n)
    expected: dict = defaultdict(lambda: [0, 0])
    for (t, _), n in best.items():
        expected[t][0] += 1
        expected[t][1] += n
    assert dict(got) == dict(expected)
