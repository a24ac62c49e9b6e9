import pytest
from hypothesis import given, strategies as st

from textloom.functions.analysis import AnalyzerConfig, analyze_text, normalize_term
from textloom.functions.words import STOP_WORDS, stem, strip_marks

STEMS = {
    "searching": "search", "searched": "search", "searches": "search", "computer": "comput", "distributed": "distribut",
    "distribution": "distribut", "systems": "system", "relational": "relat", "conditional": "condit", "operator": "oper",
    "go": "go", "in": "in", "to": "to", "OF": "OF", "consensus": "consensu", "databases": "databas", "tolerant": "toler",
    "algorithms": "algorithm", "caresses": "caress", "ponies": "poni", "agreed": "agre", "feed": "feed", "plastered": "plaster",
    "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "possibly": "possibl",
    "analogi": "analogi", "adoption": "adopt", "controll": "control", "rate": "rate", "cease": "ceas",
}


@pytest.mark.parametrize(("word", "expected"), STEMS.items())
def test_stems(word, expected):
    assert stem(word) == expected


@given(st.text(max_size=30))
def test_stem_never_fails_nor_grows(word):
    assert len(stem(word)) <= len(word.lower()) + 1


def test_stop_words():
    assert len(STOP_WORDS) == 174
    assert [t for t, *_ in analyze_text("The quick brown fox jumps over the lazy dog", AnalyzerConfig(stemming=False))] == [
        "quick", "brown", "fox", "jumps", "lazy", "dog",
    ]
    own = AnalyzerConfig.of(stemming=False, stop_words=["Distributed", "in"])
    assert [t for t, *_ in analyze_text("Distributed consensus in database systems", own)] == ["consensus", "database", "systems"]


def test_offsets_count_kept_tokens_and_filtered_text():
    config = AnalyzerConfig(stemming=False, stop_words=False)
    assert analyze_text("High-performance search engines", config) == [
        ("high", 0, 0, 4), ("performance", 1, 5, 16), ("search", 2, 17, 23), ("engines", 3, 24, 31),
    ]
    assert analyze_text("𝒳 b", AnalyzerConfig(stemming=False, stop_words=False, strip_diacritics=False))[1][2:] == (3, 4)


def test_bounds_and_folding():
    config = AnalyzerConfig.of(stemming=False, stop_words=False, min_token_length=2, max_token_length=5)
    assert [t for t, *_ in analyze_text("a ab abc abcdefghij", config)] == ["ab", "abc"]
    assert strip_marks("café crème naïve résumé façade ﬁ ²") == "cafe creme naive resume facade fi 2"
    assert [normalize_term(w) for w in ("Distributed", "Café", "Algorithms")] == ["distribut", "cafe", "algorithm"]


def test_pipeline():
    found = {t for t, *_ in analyze_text("Fault-tolerant consensus algorithms for distributed databases")}
    assert found == {"fault", "toler", "consensu", "algorithm", "distribut", "databas"}


def test_sql_functions(spark):
    from textloom.functions.register import register

    register(spark)
    row = spark.sql("SELECT stem('Searching') AS s, fold('Café') AS f, normalize_term('Databases') AS n, stem(CAST(NULL AS STRING)) AS z").first()
    assert tuple(row) == ("search", "cafe", "databas", None)
    rows = spark.sql("SELECT d.id, t.term, t.position FROM VALUES (1, 'The databases'), (2, NULL) AS d(id, text), LATERAL tokenize(d.text) t").collect()
    assert [tuple(r) for r in rows] == [(1, "databas", 0)]
