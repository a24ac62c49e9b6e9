import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from textloom.functions import codecs
from textloom.functions.snippets import highlight, make_snippet


@given(st.lists(st.integers(0, 2**32 - 1)))
def test_buffer_round_trip(numbers):
    b = codecs.Buffer()
    for n in numbers:
        b.write_varint(n)
    r = codecs.Buffer(bytes(b.data))
    assert [r.read_varint() for _ in numbers] == numbers


def test_buffer_errors():
    with pytest.raises(IndexError):
        codecs.Buffer(b"\x80").read_varint()
    with pytest.raises(ValueError, match="five"):
        codecs.Buffer(b"\x80" * 6).read_varint()
    b = codecs.Buffer()
    b.write_string("naïve")
    b.write_u8(300)
    b.write_u16(7)
    b.write_u32(9)
    b.write_f32(1.5)
    r = codecs.Buffer(bytes(b.data))
    assert (r.read_string(), r.read_u8(), r.read_u16(), r.read_u32(), r.read_f32()) == ("naïve", 44, 7, 9, 1.5)


def test_columns_equal_buffers(spark):
    lists = [[], [0, 1, 42, 127], [128, 16383, 16384, 2097151, 2097152, 268435456, 2**31 - 1, 2**32 - 1]]
    df = spark.createDataFrame([(x,) for x in lists], "n array<long>")
    coded = df.select("n", codecs.encode_varints(F.col("n")).alias("b"))
    for r in coded.select("n", "b", codecs.decode_varints(F.col("b")).alias("back")).collect():
        b = codecs.Buffer()
        for n in r.n:
            b.write_varint(n)
        assert bytes(r.b) == bytes(b.data) and r.back == r.n
    sizes = df.select(F.transform("n", codecs.varint_size).alias("s")).collect()
    assert [r.s for r in sizes] == [[], [1, 1, 1, 1], [2, 2, 3, 3, 4, 5, 5, 5]]


@pytest.mark.parametrize("raw", [b"\x80", b"\x80\x80\x80\x80\x80\x01"])
def test_bad_bytes(spark, raw):
    df = spark.createDataFrame([(raw,)], "b binary")
    with pytest.raises(Exception, match="varint"):
        df.select(codecs.decode_varints(F.col("b"))).collect()


def test_deltas(spark):
    df = spark.createDataFrame([([104, 108, 125, 160],), ([0, 3, 5, 12],), ([],), ([99],)], "n array<int>")
    coded = df.select("n", codecs.encode_deltas(F.col("n")).alias("d"))
    assert [r.d for r in coded.collect()] == [[104, 4, 17, 35], [0, 3, 2, 7], [], [99]]
    assert all(r.n == r.back for r in coded.select("n", codecs.decode_deltas(F.col("d")).alias("back")).collect())
    with pytest.raises(Exception, match="sorted"):
        spark.createDataFrame([([10, 5, 12],)], "n array<int>").select(codecs.encode_deltas(F.col("n"))).collect()


def test_delta_rows(spark):
    df = spark.createDataFrame([("t", 3), ("t", 10), ("u", 5)], "k string, v long")
    coded = codecs.encode_deltas_rows(df, "k", "v")
    assert {(r.k, r.v): r.delta for r in coded.collect()} == {("t", 3): 3, ("t", 10): 7, ("u", 5): 5}
    assert all(r.v == r.value for r in codecs.decode_deltas_rows(coded, "k", "v").collect())


def test_snippets():
    text = "x" * 200 + " Paxos and fault tolerance " + "y" * 300
    s = make_snippet(text, ["fault", "tolerance"], 60)
    assert s.startswith("...") and s.endswith("...") and "**fault** **tolerance**" in s
    assert make_snippet("short", ["zzzz"], 60) == "short" and make_snippet("", ["a"]) is None and make_snippet(None, []) is None
    assert make_snippet("abcdef" * 30, [], 10) == "abcdefabcd..."
    assert make_snippet("a distribution", ["distributed"], 100) == "a distribution"
    assert highlight("Fault faulty", ["fault"]) == "**Fault** **faulty**"
