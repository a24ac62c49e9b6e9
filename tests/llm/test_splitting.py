from hypothesis import given, settings, strategies as st

from textloom.llm.splitting import found, pieces, split

TEXTS = st.text(alphabet="ab. \n#-=<p>\\{}*é́,1_", max_size=400)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 60), st.integers(0, 40), st.booleans())
def test_pieces_cover_the_text(text, limit, overlap, word):
    out = split(text, limit, overlap, word)
    used = min(overlap, limit - 1)  # any overlap below the limit is kept
    assert out[0][0] == 0 and out[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in out) or text == ""
    assert all(c == max(0, b - used) and d > b for (_, b), (c, d) in zip(out, out[1:]))
    assert (len(out) == 1) == (len(text) <= limit)


def test_cuts_follow_the_structure():
    text = "# One\n\n" + "Short sentence here. " * 4 + "\n\n# Two\n\nLast words of it.\n"
    out = split(text, 100, 0)
    assert [text[a:b].lstrip()[:5] for a, b in out][-1] == "# Two" and len(out) == 2
    listed = "Items:\n" + "".join(f"- item number {k}\n" for k in range(12))
    assert all(listed[a:b].endswith("\n") for a, b in split(listed, 70, 0))


def test_code_blocks_stay_together():
    text = "Before it.\n\n```\na = 1\n\nb = 2\n```\n\nAfter the code comes more text of some length.\n"
    assert any("a = 1\n\nb = 2" in text[a:b] for a, b in split(text, 50, 0))


def test_words_break_inside_at_marks():
    assert [("snake_case_word" * 2)[a:b] for a, b in split("snake_case_word" * 2, 12, 0, word=True)][0].endswith("_")


def test_rows(spark):
    rows = [
        (1, "x" * 70 + " end", 1, "clash", "c"), (1, "x" * 70 + " end", 1, "clash", "c"), (2, None, 1, None, None), (3, "", None, None, None),
        (4, "word " * 100, 2, None, None), (5, "y" * 65, 99, None, None), (None, "z" * 5000, 1, None, None), (6, "long " * 40_000, 2, None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, body string, options_id int, kind string, content string")
    options = spark.createDataFrame([(1, 1000, 10, 64), (2, 120, 20, None), (None, 5, 5, 5)], "options_id int, piece_chars int, piece_overlap int, max_token_length int")
    cut = pieces(docs, options)
    assert {tuple(r) for r in found(cut).collect()} == {(1, "token", 0), (4, "body", 0), (5, "token", 0), (6, "body", 0)}
    assert cut.where("doc_id = 3").count() == 1 and cut.where("doc_id = 2 or doc_id is null").count() == 0
    assert cut.where("length(content) > 1000").count() == 0
    assert pieces(docs.limit(0), options).count() == 0 and pieces(docs, options.limit(0)).where("doc_id = 4").count() == 1


def test_leftovers_merge_and_headings_go_on():
    long = "One sentence of the text, and it goes on. " * 6
    text = f"# Top\n\n{long}\n\nShort end.\n\n## Next\n\n{long}\n\n## Last\n\nTail.\n"
    out = [text[a:b] for a, b in split(text, 120, 0)]
    assert not any(p.strip() in ("# Top", "## Next", "## Last", "Short end.") for p in out)
    assert not any(p.rstrip().endswith(("## Next", "## Last")) for p in out) and out[0].startswith("# Top\n\nOne")
    assert [b - a for a, b in split("x" * 30, 10, 9)] == [10] * 21
