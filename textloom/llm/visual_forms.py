"""One form for texts that look alike: a compiled transducer over grapheme clusters."""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from textloom.plans.session import written

# Letters that look like a Latin letter, by script.
LOOK_ALIKES = {
    "аеорсухіјѕһԁԛԝѵӏкѡԍ": "aeopcyxijshdqwvlkwg",  # Cyrillic, small
    "АВЕКМНОРСТУХІЈЅҮԚԜӀѴԌ": "ABEKMHOPCTYXIJSYQWIVG",  # Cyrillic, capital
    "νορϲϳκ": "vopcjk",  # Greek, small
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿϜϺ": "ABEZHIKMNOPTYXCJFM",  # Greek, capital
    "օսհոզցՕՍՏ": "ouhnqgOUS",  # Armenian
    "ⲟⲣⲥⲭⲞⲢⲤⲦⲬⲎⲒⲔⲘⲚⲨ": "opcxOPCTXHIKMNY",  # Coptic
    "ᎠᎢᎪᎫᎬᎳᎷᎻᏀᏃᏒᏔᏚᏞᏟᏢᏦᏴᏙᏕ": "DTAJEWMHGZRWSLCPKBVS",  # Cherokee
    "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ": "BPDTGKJCZFMNLSRVHWXYAEIOU",  # Lisu
    "ɑɡᴄᴏᴠᴡᴢꜱ": "agcovwzs",  # phonetic and small capitals
}
# Sequences that look like one Latin letter.
SEQUENCES = {"ı\u0307": "i", "ȷ\u0307": "j", "ɑ\u0307": "ȧ"}
# Hyphens that look like the hyphen-minus.
HYPHENS = "‐‑﹣－"
# Characters without a visible sign, as ranges of code points.
INVISIBLE = [
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
]
# Letters of Roman numerals as characters of their own.
NUMERALS = [(0x2160, 0x217F)]
# Fixed value: the last character that Unicode gives a decomposition.
LAST_DECOMPOSED = 0x2FA1D
#: Kinds of compatibility forms that differ in width or encoding only.
_KINDS = ("<wide>", "<narrow>", "<noBreak>", "<font>")


def _rules() -> dict[str, str]:
    """Rules: widths, ligatures and numerals from Unicode's own decompositions, spaces from their
    category, hyphens, invisible characters, and the look-alikes and sequences above."""
    rules: dict[str, str] = {}
    for cp in range(0x80, LAST_DECOMPOSED + 1):
        c = chr(cp)
        if ud.category(c) == "Zs":
            rules[c] = " "
        elif 0xFB00 <= cp <= 0xFB06 or any(a <= cp <= b for a, b in NUMERALS) or ud.decomposition(c).startswith(_KINDS):
            rules[c] = ud.normalize("NFKC", c)
    rules |= dict.fromkeys(HYPHENS, "-")
    for first, last in INVISIBLE:
        rules |= {chr(cp): "" for cp in range(first, last + 1)}
    for theirs, ours in LOOK_ALIKES.items():
        rules |= dict(zip(theirs, ours, strict=True))
    return rules | SEQUENCES


class _Tree:
    """Rules compiled to a tree of their characters, walked for the longest match at each place."""

    def __init__(self, rules: dict[str, str]) -> None:
        self.root: dict = {}
        for source, target in rules.items():
            node = self.root
            for c in source:
                node = node.setdefault(c, {})
            node[""] = target

    def rewrite(self, text: str) -> str:
        out, at = [], 0
        while at < len(text):
            node, end, target = self.root, at + 1, text[at]
            for k in range(at, len(text)):
                node = node.get(text[k])
                if node is None:
                    break
                if "" in node:
                    end, target = k + 1, node[""]
            out.append(target)
            at = end
        return "".join(out)


def checked(rules: dict[str, str]) -> dict[str, str]:
    """``rules`` closed under themselves. Raises ValueError where two paths conflict, i.e. a
    rule's result would be rewritten again without end, or differs in composed form, or a
    sequence's result isn't what its parts give by themselves and together."""
    closed: dict[str, str] = {}
    tree = _Tree(rules)
    for source, target in rules.items():
        for _ in range(4):
            following = tree.rewrite(target)
            if following == target:
                break
            target = following
        else:
            raise ValueError(f"rules for {source!r} don't end")
        closed[source] = target
    tree = _Tree(closed)
    for source, target in closed.items():
        if tree.rewrite(ud.normalize("NFC", target)) != ud.normalize("NFC", target):
            raise ValueError(f"rules for {source!r} conflict with composition")
        if len(source) > 1 and any(source != other and other in source and len(other) > 1 for other in closed):
            raise ValueError(f"the rule for {source!r} overlaps another sequence")
    return closed


class Transducer:
    """Rewrites a text in one pass, longest match first: all rules are compiled to two trees of
    characters, with and without the look-alikes.

    A step takes the longest grapheme cluster (a character with its combining marks, an emoji
    sequence) inside a word. Clusters with a pictograph pass as they are, joiners included. In
    others each character of the decomposed cluster is mapped and the rest composed, so a
    look-alike base with a separate accent becomes the one accented letter. A look-alike is
    rewritten only in a word whose letters all have a Latin form: words of other scripts stay.
    The form is a fixed point: rewriting it again changes nothing. Case is kept.
    """

    def __init__(self) -> None:
        self.rules = checked(_rules())
        self.all = _Tree(self.rules)
        self.other = _Tree({k: v for k, v in self.rules.items() if not any(k in theirs for theirs in LOOK_ALIKES)})
        hidden = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in INVISIBLE)
        self.segment = regex.compile(rf"[\w\p{{M}}{hidden}]+|[^\w\p{{M}}{hidden}]+")
        self.cluster = regex.compile(r"\X")
        self.picture = regex.compile(r"\p{Extended_Pictographic}|\p{Regional_Indicator}")
        self.memo: dict[str, str] = {}

    def _cluster(self, c: str, look_alikes: bool) -> str:
        if self.picture.search(c):
            return c
        return ud.normalize("NFC", (self.all if look_alikes else self.other).rewrite(ud.normalize("NFD", c)))

    def _latin(self, word: str) -> bool:
        """Whether every letter of the word is Latin or looks so."""
        for x in ud.normalize("NFD", word):
            x = self.rules.get(x, x)
            if any(y.isalpha() and "LATIN" not in ud.name(y, "") for y in x):
                return False
        return True

    def word(self, segment: str) -> str:
        """The form of one segment."""
        if segment.isascii():
            return segment
        known = self.memo.get(segment)
        if known is None:
            latin = self._latin(segment)
            known = "".join(self._cluster(c, latin) for c in self.cluster.findall(segment))
            # characters of separate clusters may compose once what stood between them is gone
            known = ud.normalize("NFC", known)
            if len(segment) < 64:
                if len(self.memo) > 200_000:
                    self.memo.clear()
                self.memo[segment] = known
        return known

    def segments(self, text: str) -> Iterator[tuple[str, int, int]]:
        """``(form, start, end)`` of the words and what lies between them, in order; start and
        end are in ``text``."""
        for m in self.segment.finditer(text):
            yield self.word(m[0]), m.start(), m.end()

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text
        if self.picture.search(text):  # a sequence must not be torn into segments
            parts, at = [], 0
            for m in regex.finditer(r"\X", text):
                if self.picture.search(m[0]):
                    parts += [self._plain(text[at : m.start()]), m[0]]
                    at = m.end()
            return "".join([*parts, self._plain(text[at:])])
        return self._plain(text)

    def _plain(self, text: str) -> str:
        return text if text.isascii() else ud.normalize("NFC", "".join(map(self.word, self.segment.findall(text))))


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    """Compiled once per worker."""
    return Transducer()


class Glossary:
    """Terms by their form, found in texts as wholes of words and the signs between them."""

    def __init__(self, terms: list[tuple[int, str]]) -> None:
        t = transducer()
        self.whole: dict[str, list[int]] = {}
        self.spelling = {}
        self.starts: dict[str, list[tuple[tuple[str, ...], int]]] = {}
        for i, term in terms:
            if not term or not (form := t(term).lower().strip(" ")):
                continue
            self.spelling[i] = term.lower()
            self.whole.setdefault(form, []).append(i)
            parts = tuple(f for f, *_ in t.segments(form))
            self.starts.setdefault(parts[0], []).append((parts, i))

    def same(self, term: str) -> list[int]:
        """Terms that all of ``term`` looks like without being one of their spellings."""
        found = self.whole.get(transducer()(term).lower().strip(" "), ())
        return [i for i in found if self.spelling[i] != term.lower()]

    def held(self, text: str) -> set[int]:
        """Terms that ``text`` holds as a whole at least once in another form; the shortest
        stretch with all visible signs counts, so what is invisible beside it doesn't."""
        if text.isascii():
            return set()
        lower, spans = _parts(text)
        found: set[int] = set()
        for k, first in enumerate(lower):
            for parts, i in self.starts.get(first, ()):
                if i in found or tuple(lower[k : k + len(parts)]) != parts:
                    continue
                if _raw(text, spans[k][0], spans[k + len(parts) - 1][1]) != self.spelling[i]:
                    found.add(i)
        return found


def _parts(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-case forms and places of the words of a text and of what lies between them."""
    forms: list[str] = []
    spans: list[tuple[int, int]] = []
    word: list[bool] = []
    for form, a, b in transducer().segments(text):
        if not form:
            continue
        kind = any(c == "_" or c.isalnum() for c in form)
        if forms and word[-1] == kind:  # parted by invisible signs only
            forms[-1], spans[-1] = forms[-1] + form, (spans[-1][0], b)
        else:
            forms.append(form)
            spans.append((a, b))
            word.append(kind)
    return [f.lower() for f in forms], spans


_HIDDEN = "".join(chr(c) for a, b in INVISIBLE for c in range(a, b + 1))


def _raw(text: str, start: int, end: int) -> str:
    return text[start:end].lower().strip(_HIDDEN)


def _stretches(text: str, sizes: list[int]) -> Iterator[tuple[str, str]]:
    """``(form, raw)`` of each stretch of so many parts that isn't plain ASCII."""
    lower, spans = _parts(text)
    for k in range(len(lower)):
        for n in sizes:
            if k + n <= len(lower) and not (raw := _raw(text, spans[k][0], spans[k + n - 1][1])).isascii():
                yield "".join(lower[k : k + n]), raw


def normalise(df: DataFrame, key: str = "doc_id", text: str = "body") -> DataFrame:
    """``key, form`` of each row's whole text; null stays null and empty stays empty.

    One row comes out per row that goes in, without a shuffle; ASCII texts pass unchanged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer()
        for batch in batches:
            forms = [x if x is None else t(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string())], ["key", "form"])

    pairs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return pairs.mapInArrow(run, f"key {pairs.schema['key'].dataType.simpleString()}, form string").toDF(key, "form")


#: Most rows of a glossary that is read by every worker; a larger one is joined by its forms.
MOST_TERMS = 100_000


def disguised(df: DataFrame, glossary: DataFrame, key: list[str], text: str, whole: bool) -> DataFrame:
    """``*key, term_id`` of rows whose text is (``whole``), or else holds as a whole, a form of
    a glossary term that looks the same but differs by more than case. Rows may repeat. Null
    and empty texts give none. Texts of visible ASCII characters only can't differ and are
    passed by in the JVM; all others go through the transducer. A glossary above MOST_TERMS rows
    is joined with the forms of the texts' stretches of as many parts as its terms have."""
    known = glossary.where("term is not null and term_id is not null").select("term_id", "term")
    few = known.limit(MOST_TERMS + 1).collect()
    kept = df.select(*key, F.col(text).alias("_text")).where(
        F.col("_text").rlike(r"[^\x21-\x7e]" if whole else r"[^\x00-\x7f]")
    )
    kinds = ", ".join(f"{k} {kept.schema[k].dataType.simpleString()}" for k in key)
    if len(few) > MOST_TERMS:
        return _joined(kept, known, key, kinds, whole)
    terms = [(r[0], r[1]) for r in few]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Glossary(terms)
        find = held.same if whole else held.held
        for batch in batches:
            at, ids = [], []
            for k, x in enumerate(batch.column(len(key)).to_pylist()):
                for i in sorted(find(x)):
                    at.append(k)
                    ids.append(i)
            rows = pa.array(at, pa.int64())
            columns = [batch.column(k).take(rows) for k in range(len(key))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.int32())], [*key, "term_id"])

    return kept.mapInArrow(run, f"{kinds}, term_id int")


def _joined(kept: DataFrame, glossary: DataFrame, key: list[str], kinds: str, whole: bool) -> DataFrame:
    """The rows of ``disguised`` by an equi-join of forms, for a glossary of any size."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer()
        for batch in batches:
            forms = [t(x).lower().strip(" ") for x in batch.column(1).to_pylist()]
            parts = [sum(1 for f, *_ in t.segments(f) if f) for f in forms]
            spelling = [x.lower() for x in batch.column(1).to_pylist()]
            columns = [batch.column(0), *map(pa.array, (forms, spelling)), pa.array(parts, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["term_id", "_form", "_spelling", "_parts"])

    kind = glossary.schema["term_id"].dataType.simpleString()
    known = written(glossary.mapInArrow(terms, f"term_id {kind}, _form string, _spelling string, _parts int").where("_form <> ''"))
    # bounded by the longest term
    sizes = sorted(r[0] for r in known.select("_parts").distinct().collect())

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer()
        for batch in batches:
            at, forms, raws = [], [], []
            for k, x in enumerate(batch.column(len(key)).to_pylist()):
                found = [(t(x).lower().strip(" "), x.lower())] if whole else _stretches(x, sizes)
                for form, raw in found:
                    at.append(k)
                    forms.append(form)
                    raws.append(raw)
            rows = pa.array(at, pa.int64())
            columns = [batch.column(k).take(rows) for k in range(len(key))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(forms, pa.string()), pa.array(raws, pa.string())], [*key, "_form", "_raw"])

    found = kept.mapInArrow(stretches, f"{kinds}, _form string, _raw string").distinct()
    return found.join(known.hint("merge"), "_form").where("_raw <> _spelling").select(*key, F.col("term_id").cast("int").alias("term_id"))
