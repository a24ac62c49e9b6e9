"""Stop words and the suffix-stripping stemmer, as plain Python on single words."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# English stop words, compared after folding and before stemming.
STOP_WORDS = frozenset(
    """
a about above after again against all am an and any are aren arent as at be because been before being below between both
but by can cannot cant could couldn couldnt d did didn didnt do does doesn doesnt doing don dont down during each few for
from further had hadn hadnt has hasn hasnt have haven havent having he her here hers herself him himself his how i if in
into is isn isnt it its itself just ll m ma me mightn mightnt more most mustn mustnt my myself needn neednt no nor not now
o of off on once only or other our ours ourselves out over own re s same shan shant she should shouldn shouldnt so some
such t than that the their theirs them themselves then there these they this those through to too under until up ve very
was wasn wasnt we were weren werent what when where which while who whom why will with won wont would wouldn wouldnt y you
your yours yourself yourselves
""".split()
)

# Suffixes of the second, third and fourth step with what takes their place, in the order they are tried.
SECOND = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
THIRD = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
FOURTH = [
    ("al", ""), ("ance", ""), ("ence", ""), ("er", ""), ("ic", ""), ("able", ""), ("ible", ""), ("ant", ""), ("ement", ""), ("ment", ""),
    ("ent", ""), ("ou", ""), ("ism", ""), ("ate", ""), ("iti", ""), ("ous", ""), ("ive", ""), ("ize", ""),
]
#: The rules of each step, and the least measure of what they leave.
STEPS = [(SECOND, 1), (THIRD, 1), (FOURTH, 2)]

def shape(word: str) -> str:
    """'v' for each vowel of the word and 'c' for everything else; y is a vowel after a 'c'."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out[-1:] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return shape(word).count("vc")


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _plural(w: str) -> str:
    if w.endswith(("sses", "ies")):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) else w
    cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
    if not cut or "v" not in shape(w[:-cut]):
        return w
    w = w[:-cut]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if _doubled(w):
        return w if w[-1] in "lsz" else w[:-1]
    return w + "e" if _measure(w) == 1 and _short_end(w) else w


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a word: Porter's algorithm of 1980 with these differences. Words of up to two
    UTF-16 units come back as they are, case included; others are lower-cased. A final s always
    goes, except after s; 'bli' becomes 'ble' and 'logi' stays; 'ion' is tried after, not instead
    of, the other suffixes of the fourth step. Whatever isn't a vowel counts as a consonant."""
    if len(word.encode("utf-16-le", "surrogatepass")) <= 4:
        return word
    w = _past(_plural(word.lower()))
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    for rules, least in STEPS:
        hit = next(((a, b) for a, b in rules if w.endswith(a)), None)
        if hit and _measure(w[: len(w) - len(hit[0])]) >= least:
            w = w[: len(w) - len(hit[0])] + hit[1]
    if w.endswith(("sion", "tion")) and _measure(w[:-3]) > 1:
        w = w[:-3]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short_end(w[:-1]):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def strip_marks(text: str) -> str:
    """Compatibility decomposition without the combining marks from U+0300 to U+036F."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not "\u0300" <= c <= "\u036f")
