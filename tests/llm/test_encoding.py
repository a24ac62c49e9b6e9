import os

import pytest
from hypothesis import given, settings, strategies as st

from textloom.llm import encoding

pytestmark = pytest.mark.skipif(not os.path.exists(f"{encoding.TOKENIZERS}/{encoding.BYTE_BPE}"), reason="no tokenizer files")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_round_trip_and_offsets(text):
    spans = encoding.spans(text)
    assert encoding.decode_ids([i for i, *_ in spans]) == text
    assert all(0 <= a <= b <= len(text) for _, a, b in spans)


def test_split_characters():
    spans = encoding.spans("𝒳")
    assert len(spans) > 1 and {(a, b) for _, a, b in spans} == {(0, 1)}


def test_groups():
    assert list(encoding.groups(["a"] * 600)) == [(0, 256), (256, 512), (512, 600)]
    assert list(encoding.groups([None, "x" * (1 << 21), "y"])) == [(0, 1), (1, 2), (2, 3)]
    assert list(encoding.groups([])) == []


def test_rows(spark):
    rows = [(1, "Hello <|endoftext|> world", "k"), (2, None, "k"), (3, "", None), (3, "", None), (None, "x", ""), (4, "ab " * 200_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    out = encoding.encode(df)
    got = [(r.doc_id, len(r.ids)) for r in out.collect()]
    assert len(got) == 6 and (2, 0) in got and got.count((3, 0)) == 2 and 50256 not in out.where("doc_id = 1").first().ids
    assert {r.doc_id: r.text for r in encoding.decode(out).collect() if r.doc_id} == {1: rows[0][1], 2: "", 3: "", 4: rows[5][1]}
    assert {r.doc_id: r.n_tokens for r in encoding.token_counts(df).collect()} == dict(got)
    assert encoding.encode(df.limit(0)).count() == 0


def test_equals_the_other_library(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["naïve  café\n\n 12345", "検索語 👩‍💻 ok", "don't I'LL  \t x", " \u00a0 "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.ids for r in encoding.encode(df).collect()} == {k: other.encode_ordinary(t) for k, t in enumerate(texts)}


def test_spans_of_rows(spark):
    from textloom.llm.encoding import encode_spans, spans

    texts = ["Straße 👩‍💻 x", "", None, "plain words"]
    out = encode_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in out:
        assert list(zip(r.ids, r.starts, r.ends)) == spans(texts[r.doc_id] or "")
    assert [r.ids for r in out if not texts[r.doc_id]] == [[], []]
