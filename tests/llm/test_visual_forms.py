import pytest
from hypothesis import given, settings, strategies as st

from textloom.llm.visual_forms import Glossary, checked, disguised, normalise, transducer


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_forms_are_fixed_points(text):
    t = transducer()
    assert t(t(text)) == t(text)


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("ｃｏｄｅｃ", "codec"), ("ѕtrаße", "straße"), ("со́te", "cóte"), ("hit count", "hit count"), ("oﬀset ﬂush", "offset flush"),
        ("co‑oc\u200bcur", "co-occur"), ("привет", "привет"), ("λόγος", "λόγος"), ("👩‍💻 ok", "👩‍💻 ok"), ("a  b\n\tc", "a  b\n\tc"), ("", ""),
        ("e\u200b\u0301", "é"), ("ＰＨＲＡＳＥ", "PHRASE"), ("²", "²"),
    ],
)
def test_forms(text, form):
    assert transducer()(text) == form


def test_conflicts_are_refused():
    with pytest.raises(ValueError, match="don't end"):
        checked({"a": "b", "b": "a"})


def test_glossary():
    g = Glossary([(1, "cote"), (2, "côté"), (3, "hit count"), (4, "edit"), (5, "edit distance"), (6, None), (7, "")])
    assert g.same("сote") == [1] and g.same("cote") == [] and g.same("COTE") == [] and g.same("co\u0302te\u0301") == [2] and g.same(" cote") == [1]
    assert g.held("a hit\u00a0count, hit  count") == {3} and g.held("hit  count é") == set()
    assert g.held("еdit distance") == {4, 5} and g.held("xеdit") == set() and g.held("edit\u200b é") == set()


def test_rows(spark):
    rows = [(1, 0, "ｃache", "k"), (1, 0, "ｃache", "k"), (2, None, None, None), (None, 3, "cаche", None), (3, 1, "", ""), (4, 2, "cache ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, position int, term string, _other string")
    glossary = spark.createDataFrame([(7, "cache"), (None, "x"), (8, None)], "term_id int, term string")
    out = {tuple(r) for r in disguised(df, glossary, ["doc_id", "position"], "term", True).collect()}
    assert out == {(1, 0, 7), (None, 3, 7), (4, 2, 7)}
    assert disguised(df.limit(0), glossary, ["doc_id"], "term", False).count() == 0
    assert disguised(df, glossary.limit(0), ["doc_id"], "term", False).count() == 0
    long = spark.createDataFrame([(1, "а " * 300_000), (2, None), (3, "")], "doc_id long, body string")
    forms = {r.doc_id: r.form for r in normalise(long).collect()}
    assert forms[1] == "a " * 300_000 and forms[2] is None and forms[3] == ""


@pytest.mark.parametrize(("text", "form"), [("кеrnel", "kernel"), ("Ⅻ ⅰndex", "XII index"), ("ı\u0307ndex", "index"), ("Ꭺꮯ", "Ꭺꮯ"), ("ᏟАᏟHE", "CACHE"), ("ꜱegment", "segment"), ("ⲟffset", "offset")])
def test_more_scripts_and_sequences(text, form):
    assert transducer()(text) == form


def test_longest_match_and_overlaps():
    from textloom.llm.visual_forms import _Tree

    assert _Tree({"a": "1", "ab": "2", "abc": "3"}).rewrite("abcabaxb") == "321xb"
    with pytest.raises(ValueError, match="overlaps"):
        checked({"ab": "x", "abc": "y"})


def test_large_glossaries_are_joined(spark, monkeypatch):
    terms = [(1, "cote"), (2, "côté"), (3, "hit count"), (4, "edit"), (5, "edit distance"), (6, None), (7, ""), (8, "cache")]
    glossary = spark.createDataFrame(terms, "term_id int, term string")
    texts = ["сote", "a hit\u00a0count, hit  count", "еdit distance", "xеdit", "edit\u200b é", "hit  count é", "co\u0302te\u0301", "ｃache \u00a0", None, "", "cache"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, body string")
    few = [{tuple(r) for r in disguised(df, glossary, ["doc_id"], "body", w).collect()} for w in (True, False)]
    monkeypatch.setattr("textloom.llm.visual_forms.MOST_TERMS", 3)
    many = [{tuple(r) for r in disguised(df, glossary, ["doc_id"], "body", w).collect()} for w in (True, False)]
    assert many == few and (1, 3) in many[1] and (2, 5) in many[1] and (6, 2) in many[0]


def test_coverage_of_public_confusables(spark):
    """Of the letters that the Unicode data in Spark's own ICU library gives the form of a Latin letter
    of the same case, so many are rewritten in the scripts that texts are mixed from."""
    import string
    import unicodedata as ud

    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    t, covered = transducer(), {}
    for script in ("CYRILLIC", "GREEK", "FULLWIDTH", "MATHEMATICAL", "ROMAN", "SMALL", "CHEROKEE", "COPTIC"):
        letters = [chr(c) for c in range(0x80, 0x1F000) if ud.name(chr(c), "").startswith(script + " ") and ud.category(chr(c))[0] in "LN"]
        forms = dict(zip([*letters, *string.ascii_letters], checker.getSkeleton("\n".join([*letters, *string.ascii_letters])).split("\n"), strict=True))
        same = [(c, x) for c in letters for x in string.ascii_letters if forms[c] == forms[x] and c.isupper() == x.isupper()]
        letters = {c for c, _ in same}
        covered[script] = sum(any(t("a" + c) == "a" + x for d, x in same if d == c) for c in letters) / max(1, len(letters))
    assert covered["FULLWIDTH"] == 1 and covered["CYRILLIC"] > 0.8 and min(covered.values()) > 0.5, covered
