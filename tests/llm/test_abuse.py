import math
import re
from collections import Counter

import pytest

from textloom.llm import abuse


@pytest.fixture(scope="module")
def restore():
    return abuse.Restorer({"the": 5.0, "index": 4.0, "of": 4.0, "shard": 2.0, "merge": 2.0})


@pytest.mark.parametrize(
    ("token", "word"),
    [
        ("1d!0t", "idiot"), ("m0r0n", "moron"), ("g*eule", "gueule"), ("d*****s", "dumbass"), ("breaaasts", "breasts"), ("s#x", "sex"),
        ("g.u.e.u.l.e", "gueule"), ("ѕ\u200bcumbаg", "scumbag"), ("IDIOT!!", "idiot!!"), ("index", "index"), ("2.8.4", "2.8.4"), ("x86", "x86"),
    ],
)
def test_restores(restore, token, word):
    assert restore(token) == word


#: Sentences that stand in no table.
BAD = [
    "What an imbecile you are", "You are a stupid liar and everyone hates you.", "all immigrants are rats", "send me your nude pics, I want to fuck you",
    "Du bist so ein 1d!ot, halt dein maul", "je vais te tuer, sale c0nnard", "eres una b a s u r a", "your mother is a wh0re", "those people are vermin",
]
GOOD = [
    "", "kill the parent and every orphaned child process dies", "The word list flags terms such as idiot or porn.", "Le mot « idiot » figure dans la liste noire.",
    "the naive approach is a dumb loop", "breast cancer abstracts", "the column sex holds m, f or null", "a master and 256 slaves", "our moderators removed 4096 insults",
    "don't shoot yourself in the foot", "der nackte zeiger zeigt auf ein totes objekt", "strip the body, expose the header, and finger the client", "5 * 8 * 2",
]


def test_prior_alone(restore):
    read, model = abuse.Reader(restore), abuse.Model()
    assert (model.scores([read(t) for t in BAD]) >= abuse.THRESHOLD).all()
    assert (model.scores([read(t) for t in GOOD]) < abuse.THRESHOLD).all()


def test_scores_go_by_sentence_and_text(restore):
    read, model = abuse.Reader(restore), abuse.Model()
    apart = model.scores([read("You are here. An idiot proof lock"), read("you"), [], read("idiot"), read("?!"), read("you idiot")])
    assert apart[2] == apart[4] == 0 and apart[5] > 0.5 > apart[0] >= max(apart[1], apart[3])


def test_fits_labels(restore):
    """Words of no list are learned from labels of texts, some of them mistaken."""
    import random

    rng, read = random.Random(3), abuse.Reader(restore)
    plain = [f"w{k}" for k in range(200)]
    sentence = lambda *extra: " ".join([*rng.sample(plain, 6), *extra, *rng.sample(plain, 2)]) + "."
    texts, labels = [], []
    for k in range(900):
        bad = k % 15 == 0
        texts.append(" ".join([sentence(), sentence(*(["zorg", "blat"] if bad else [])), sentence()]))
        labels.append(bad if k % 150 != 1 else True)
    numbers = [read(t) for t in texts]
    weights, classes = abuse.fitted(numbers[:600], abuse.np.array(labels[:600]))
    found = abuse.Model(weights=weights, classes=classes).scores(numbers[600:]) >= abuse.THRESHOLD
    truth = [k % 15 == 0 for k in range(600, 900)]
    assert sum(f == t for f, t in zip(found, truth, strict=True)) >= 297


def test_rows(spark):
    rows = [(1, "You are such a moron, stop.", "a", 1.0), (2, None, "a", None), (3, "", None, None), (4, "fine " * 100_000, "b", 0.5), (4, "fine", "b", None), (None, "x", "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(1, 1), (1, None), (4, 0), (None, 1), (2, 0), (9, 1)], "doc_id long, toxic int")
    out = abuse.scores(df, abuse.fit(df, labels), keep=("source",))
    assert {r.doc_id for r in out.where("score >= 0.5").collect()} == {1} and out.count() == 6
    rates = {r.source: (r.documents, r.abusive) for r in abuse.rates(out.dropDuplicates(["doc_id"])).collect()}
    assert rates["a"] == (2, 1) and rates[None] == (1, 0)
    empty = df.limit(0)
    model = abuse.fit(empty, labels.limit(0))
    assert model.grams == {} and abuse.scores(empty, model).count() == 0
    assert abuse.scores(df, model).where("score >= 0.5").count() == 1


def test_masks_are_decoded_exactly():
    trie = abuse.Trie(["idiot", "idiots", "moron", "merde"])
    assert [trie.viterbi(x) for x in ("i****", "m***n", "m****", "*****s", "q**", "i-d-i-*-t")] == ["idiot", "moron", "merde", "idiots", None, "idiot"]


def test_model_counts_every_text(spark):
    letters = "abcdefghij"
    texts = [" ".join("q" + "".join(letters[int(x)] for x in str(n)) for n in range(4 * k, 4 * k + 4)) for k in range(6_000)]
    texts += ["Жук naïve the"] * 9_000 + ["morooons moroooons"] * 9
    fitted = abuse.fit_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    counts = Counter(re.sub(r"(.)\1{2,}", r"\1", w) for t in texts for w in t.lower().split())
    words = {w: math.log1p(n) for w, n in counts.items()}
    assert len(words) > 23_000 and fitted.mean == pytest.approx(sum(words.values()) / len(words), abs=1e-5)
    whole, model = abuse.CharacterModel(words), abuse.CharacterModel({}, grams=fitted)
    for word in ["qjjj", "qcdeff", "naïve", "the", "zzz", "idiot"]:
        padded = "\x02" * 4 + word + "\x02"
        for k in range(4, len(padded)):
            assert model.logp(padded[k - 4 : k], padded[k]) == pytest.approx(whole.logp(padded[k - 4 : k], padded[k]), abs=1e-4)
    assert abuse.Restorer(fitted)("you morooons, moroooons") == "you morons, morons"


@pytest.mark.parametrize(
    ("token", "word"),
    [
        ("a55h0l3", "asshole"), ("1d10t", "idiot"), ("1d" + "i" * 60 + "0t", "idiot"), ("i" * 50 + "diot", "idiot"), ("m-" * 30 + "0-r-0-n", "moron"),
        ("d" + "*" * 5 + "s", "dumbass"), ("107", "107"), ("934ms", "934ms"), ("3.14e-10", "3.14e-10"), ("a1b2c3d4e5f6" * 5, "a1b2c3d4e5f6" * 5),
    ],
)
def test_restores_digits_and_long_tokens(restore, token, word):
    assert restore(token) == word
