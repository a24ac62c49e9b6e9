from textloom import catalog

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return [tuple(r) for r in catalog.queries()[name](spark, SF).collect()]


def test_lexicon_sorted_is_whole(spark):
    every = sorted(run(spark, "term_stats"))
    assert len(every) > 200 and run(spark, "lexicon_sorted") == every


def test_varint_encode_takes_all_keys(spark, tmp_path):
    codes = {
        0: "00", 2097151: "FFFF7F", 2097152: "80808001", 268435455: "FFFFFF7F", 268435456: "8080808001",
        2**32 - 1: "FFFFFFFF0F", 2**32 + 1: "01", -1: "FFFFFFFF0F", None: None,
    }
    spark.createDataFrame([(k,) for k in codes], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert dict(map(tuple, catalog.queries()["varint_encode"](spark, str(tmp_path)).collect())) == codes


def test_number_documents_without_a_path(spark, tmp_path):
    rows = [(5, None), (1, "b"), (2, "a"), (4, None), (3, "a")]
    spark.createDataFrame(rows, "doc_id long, path string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.queries()["number_documents"](spark, str(tmp_path)).collect()
    assert dict(map(tuple, found)) == {2: 1, 3: 2, 1: 3, 4: 4, 5: 5}


def test_table_function_takes_whole_texts(spark):
    assert sorted(run(spark, "tokenize_table_function")) == sorted(run(spark, "tokenize_positions"))
