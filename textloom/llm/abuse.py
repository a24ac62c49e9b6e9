"""Abusive, hateful or sexual content: noisy-channel restoration, then a classifier of the restored sentences."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.llm.visual_forms import transducer
from textloom.plans.session import cut

# Words of four languages by what they do in a sentence; single words, some of them met in labelled texts.
LEXICON = {
    # who is spoken to
    "you": """you your yours yourself yourselves ur u ya
        du dich dir dein deine deinen deinem deiner euch ihr eure euer
        tu te toi ton ta tes vous votre vos t
        tú ti tus vosotros ustedes usted vuestro te eres""",
    # who is spoken to or of as a kind
    "group": """people immigrants immigrant migrants migrant foreigners foreigner refugees refugee women men gays gay lesbians muslims muslim jews
        jew christians blacks whites asians mexicans arabs gypsies race races tribe tribes clan clans settlers ethnic kind folk lot they them those
        ausländer flüchtlinge migranten frauen juden muslime schwarze rasse pack volk leute
        étrangers immigrés migrants réfugiés femmes juifs musulmans noirs arabes race gens peuple
        extranjeros inmigrantes migrantes refugiados mujeres judíos musulmanes negros moros raza gente pueblo""",
    "insult": """idiot idiots idiotic moron morons moronic imbecile imbeciles jerk jerks scumbag scumbags dumbass dumbasses jackass asshole assholes loser losers
        clown clowns pig pigs swine bastard bastards parasite parasites halfwit halfwits cretin cretins dimwit nitwit dickhead dipshit
        bitch bitches whore whores slut sluts wanker wankers twat prick pricks cunt cunts motherfucker motherfuckers douchebag scum retard retards retarded
        fool fools dunce simpleton bonehead creep creeps freak freaks weirdo coward cowards liar garbage trash pathetic worthless disgusting brainless
        arschloch arschlöcher dummkopf trottel vollidiot vollidioten wichser hurensohn drecksack mistkerl schwachkopf depp miststück schlampe
        fotze idioten versager dreckskerl blödmann spinner penner arsch missgeburt abschaum
        crétin crétins connard connards connasse con conne abruti abrutis débile débiles ordure ordures salaud salauds salope salopes enculé enfoiré
        imbécile imbéciles bouffon bouffons pute putain batard bâtard raclure minable
        imbécil imbéciles idiota idiotas estúpido estúpida estúpidos cabrón cabrones basura gilipollas pendejo pendejos puta putas payaso inútil
        tonto tontos mierdas maricón zorra""",
    "coarse": """fuck fucking fucked fucker shit shitty crap crappy bullshit dumb stupid damn ass hell piss shut
        fresse scheiße scheiss scheiß verpiss verdammt dumm blöd halt maul fick
        gueule merde chier foutre ferme nique casse
        mierda joder coño jode cállate puto""",
    "threat": """kill killing kills murder die dead death hang stab shoot shot beat burn rape hurt break smash choke strangle destroy find hunt slit
        töte töten umbringen bringe stirb sterben verrecke schlagen verprügeln finde erschießen
        tuer tue crève crever mourir frapper égorger buter trouver
        matar mato muere morir muérete golpear romper quemar encontrar""",
    "dehumanise": """rats rat vermin cockroaches cockroach parasites parasite subhuman subhumans animals animal savages savage plague filth filthy dirty disease
        inferior scum human criminals thieves liars lazy rapists leeches breed exterminated deported
        ungeziefer untermenschen minderwertig parasiten abschaum ratten dreckig rausgeworfen kriminelle tiere
        vermine rats cafards sale sales parasites inférieurs voleurs criminels sauvages animaux
        escoria ratas plaga cucarachas parásitos sucia sucio inferiores ladrones criminales animales""",
    "sexual": """sex sexy porn porno pornos pornographic xxx nude nudes naked nudity horny hardcore strippers stripper webcam escort escorts cock cocks dick dicks pussy pussies
        tits boobs breasts cum blowjob blowjobs handjob orgasm orgasms gangbang fetish erotic masturbate masturbating moaned undressed milf anal
        nackt nackte nackten nacktfotos nacktbilder geil geile geilen pornos sexvideos titten schwanz muschi bumsen ficken erotik
        nue nues nu nus sexe sexuel porno pornos bite chatte seins baiser excité excitée coquine
        desnuda desnudas desnudo desnudos cachondo cachonda sexo polla coño tetas follar pornográfico""",
    # who speaks of words, lists or medicine rather than with them
    "naming": """word words term terms phrase phrases list lists flag flags flagged quote quoted insult insults moderator moderators filter filters abstract abstracts
        medical medicine medically cancer patients survey column columns health leaflet leaflets study studies report reported article penetration test tests label labels
        mot mots terme termes figure liste filtre wort wörter liste filter wortliste begriff begriffe palabra palabras término términos lista filtro""",
    "not": "not no never don doesn isn aren without nicht kein keine nie ne pas jamais sans no nunca sin",
}
CLASSES = tuple(LEXICON)

# What is held before any label is seen: weights of classes in a sentence, alone and in pairs.
PRIOR = {
    "": -5.0, "insult": 2.5, "coarse": 1.0, "sexual": 2.0, "threat": 0.0, "dehumanise": 0.5, "group": 0.0, "you": 0.0, "naming": -1.0, "not": 0.0,
    "insult you": 4.0, "coarse you": 2.5, "coarse insult": 2.5, "threat you": 4.0, "dehumanise group": 5.0, "insult group": 2.0,
    "sexual you": 2.0, "coarse sexual": 1.5, "insult naming": -4.0, "coarse naming": -3.0, "naming sexual": -3.5, "naming threat": -3.0,
    "dehumanise naming": -3.0, "naming you": -0.5,
}

# Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "!": "il", "|": "il", "3": "e", "€": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "+": "t",
    "8": "b", "9": "g", "6": "gb", "2": "z", "(": "c", "¡": "i", "£": "l",
}
_ANY = set("*#%?&^~")
_ALPHABET = "abcdefghijklmnopqrstuvwxyzàáâäçèéêëíîïñóôöúùûüßœ"
_EDGE = "\x02"
_OTHER = "\x03"
_ORDER = 5


class Grams(dict[str, float]):
    """Summed weights of each letter with up to four signs before it, over the words of a table;
    ``mean`` is the mean weight of a word."""

    mean = 0.0


class CharacterModel:
    """Letters of words given the letters before them, by interpolated counts up to ``order``;
    ``grams`` are added to the counts of ``words``."""

    def __init__(self, words: dict[str, float], order: int = _ORDER, grams: Grams | None = None) -> None:
        self.order = order
        self.counts: list[dict[str, dict[str, float]]] = [{} for _ in range(order)]
        for word, weight in words.items():
            padded = _EDGE * (order - 1) + word + _EDGE
            for k in range(order - 1, len(padded)):
                for n in range(order):
                    row = self.counts[n].setdefault(padded[k - n : k], {})
                    row[padded[k]] = row.get(padded[k], 0) + weight
        for gram, weight in (grams or {}).items():
            row = self.counts[len(gram) - 1].setdefault(gram[:-1], {})
            row[gram[-1]] = row.get(gram[-1], 0) + weight
        self.totals = [{h: sum(row.values()) for h, row in level.items()} for level in self.counts]
        self.memo: dict[tuple[str, str], float] = {}

    def logp(self, history: str, c: str) -> float:
        key = (history, c)
        known = self.memo.get(key)
        if known is None:
            p = 1e-4
            for n in range(self.order):
                h = history[len(history) - n :] if n else ""
                total = self.totals[n].get(h, 0.0)
                if total:
                    p = (self.counts[n][h].get(c, 0.0) + 2 * p) / (total + 2)
            known = self.memo[key] = math.log(p)
        return known


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Per sign of a token the letters it may stand for with the channel's log-probability;
    the empty letter skips a separator or a repetition, ``*`` is any letter."""
    steps: list[list[tuple[str, float]]] = []
    for k, c in enumerate(token):
        if c in _ANY:
            steps.append([("*", -3.5), ("", -6.0)])
        elif c in LEET:
            sure = [(a, -0.7) for a in LEET[c]]
            steps.append([*sure, *([] if c.isdigit() else [("*", -4.0)]), ("", -5.0)])
        elif c.isalpha():
            again = k > 0 and token[k - 1] == c
            steps.append([(c, -0.1), ("", -1.0)] if again else [(c, -0.02)])
        else:
            steps.append([("", -0.1)])
    return steps


def viterbi(token: str, model: CharacterModel) -> str:
    """The likeliest word behind a token without masks. A sign stands for few letters, so
    all histories are kept: the result is exact."""
    keep = model.order - 1
    states: dict[str, tuple[float, str]] = {_EDGE * keep: (0.0, "")}
    for step in lattice(token):
        following: dict[str, tuple[float, str]] = {}
        for history, (score, word) in states.items():
            for letter, channel in step:
                if letter == "*":
                    continue
                if letter:
                    s, h, w = score + channel + model.logp(history, letter), (history + letter)[-keep:], word + letter
                else:
                    s, h, w = score + channel, history, word
                if h not in following or s > following[h][0]:
                    following[h] = (s, w)
        states = following
    return max(((s + model.logp(h, _EDGE), w) for h, (s, w) in states.items()), default=(0.0, token))[1]


class Trie:
    """Known words as a tree of letters; the states of the decoding of masked tokens."""

    def __init__(self, words: Iterable[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        for word in sorted(words):
            node = 0
            for c in word:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.word.append(None)
                node = self.next[node][c]
            self.word[node] = word

    def viterbi(self, token: str) -> str | None:
        """The known word most likely behind a token, all known words being equally likely; the
        first of equals. A state is a node of the tree, so the decoding is exact."""
        states = {0: 0.0}
        for step in lattice(token):
            following: dict[int, float] = {}
            for node, score in states.items():
                for letter, channel in step:
                    if not letter:
                        reached: Iterable[int] = (node,)
                    elif letter == "*":
                        reached = self.next[node].values()
                    else:
                        reached = (self.next[node][letter],) if letter in self.next[node] else ()
                    for n in reached:
                        if score + channel > following.get(n, -math.inf):
                            following[n] = score + channel
            states = following
        whole = [(-s, self.word[n]) for n, s in states.items() if self.word[n]]
        return min(whole)[1] if whole else None


@lru_cache(maxsize=1)
def _vocabulary() -> frozenset[str]:
    kinds = ("insult", "coarse", "threat", "dehumanise", "sexual")
    return frozenset(w for k in kinds for w in LEXICON[k].split())


_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][.\-_*·  ]){2,}[^\W\d_](?![^\W_])")
_ODD = re.compile(r"[0-9!|€@$+(¡£*#%?&^~]")
_MASK = re.compile(r"[*#%@$]")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_CORE = re.compile(r"^[\"'“”«»‘’(\[{<.,;:]+|[\"'“”«»‘’)\]}>.,;:!?]+$")


def squeezed(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


class Restorer:
    """Brings disguised words back: look-alikes and invisible signs by the transducer, leetspeak,
    masks, separators and repetitions by decoding. A token is decoded only if it holds letters
    besides odd signs, and the result is taken only if it is a known word: one of the lexicon,
    or one of ``learned``. Tokens of more than 40 signs are shortened first; those of few letters
    are decoded like masked ones."""

    def __init__(self, counts: dict[str, float], learned: Iterable[str] = ()) -> None:
        self.known = known = _vocabulary() | frozenset(learned)
        self.longest = max(map(len, known))
        words, grams = ({}, counts) if isinstance(counts, Grams) else (counts, Grams())
        weight = 4.0 * max(1.0, grams.mean, sum(words.values()) / max(1, len(words)))
        self.model = CharacterModel({**words, **{w: words.get(w, 0) + weight for w in sorted(known) if len(w) > 2}}, grams=grams)
        #: Nobody masks harmless words, so a masked token's letters come from the known ones alone.
        self.masked = Trie(w for w in known if len(w) > 2)
        self.short = {squeezed(w) for w in known}

    def shortened(self, token: str) -> str:
        """A token without separators, with a letter at most twice in a row and another sign at most
        as often as the longest known word has letters."""
        signs = "".join(c for c in token if c.isalpha() or c in LEET or c in _ANY)
        return re.sub(r"(.)\1{2,}", lambda m: m[1] * min(len(m[0]), 2 if m[1].isalpha() else self.longest), signs)

    def token(self, token: str) -> str:
        """The restored form of what stands between two blanks, in lower case."""
        core = _CORE.sub("", token)
        letters = sum(c.isalpha() for c in core)
        if core in self.known or letters < 1 or len(core) < 3:
            return token
        form = core if len(core) <= 40 else self.shortened(core)
        # each letter that doesn't repeat the one before it stays in the word
        if len(form) > 40 and sum(c.isalpha() and c != before for before, c in zip(" " + form, form, strict=False)) > self.longest:
            return token
        odd = bool(_ODD.search(form))
        rich = odd and (letters * 3 < len(core) and "*" not in core or sum(c.isdigit() for c in core) * 2 > len(core))
        if not odd and not (_DOUBLE.search(form) and squeezed(form) in self.short):
            return token
        word = self.masked.viterbi(form) if rich or _MASK.search(form) else viterbi(form, self.model)
        return token.replace(core, word, 1) if word in self.known and (len(word) > 2 or not rich) else token

    def joined(self, text: str) -> str:
        """The text with words whose letters are set apart written as words, if they are known."""

        def one(m: re.Match[str]) -> str:
            word = transducer()("".join(c for c in m[0] if c.isalpha())).lower()
            best = viterbi(word, self.model)
            return best if best in self.known and len(best) > 2 else m[0]

        return _SPACED.sub(one, text)

    def __call__(self, text: str) -> str:
        return re.sub(r"\S+", lambda m: self.token(transducer()(m[0]).lower()), self.joined(text))


# Features -------------------------------------------------------------------------------

_PIECES = re.compile(r"\S+|\n")
_WORDS = re.compile(r"[^\W_]+")
_ENDS = re.compile(r"[.?!。…][\"'“”«»‘’)\]]*$")
#: Hashed n-grams: bits of a weight's place, longest n-gram.
BITS, LONGEST = 20, 3
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_CLASS_BITS = 16


@lru_cache(maxsize=1)
def _classes() -> dict[str, int]:
    out: dict[str, int] = {}
    for k, words in enumerate(LEXICON.values()):
        for w in words.split():
            out[w] = out.get(w, 0) | 1 << k
    return out


class Reader:
    """Texts as numbers: each restored word as its hash with its classes in the lowest bits, a
    zero after each sentence. What a token gives is kept, as most tokens come again."""

    def __init__(self, restorer: Restorer) -> None:
        self.restorer = restorer
        self.memo: dict[str, list[int]] = {"\n": [0]}

    def _numbers(self, token: str) -> list[int]:
        form = self.restorer.token(transducer()(token).lower())
        words = _WORDS.findall(form)
        out: list[int] = []
        if words:
            hashes = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
            out = [(int(h) >> _CLASS_BITS << _CLASS_BITS) | _classes().get(w, 0) for w, h in zip(words, hashes, strict=True)]
        if _ENDS.search(form):
            out.append(0)
        if len(token) < 64:
            if len(self.memo) > 400_000:
                self.memo = {"\n": [0]}
            self.memo[token] = out
        return out

    def __call__(self, text: str) -> list[int]:
        memo, out = self.memo, []
        for t in _PIECES.findall(self.restorer.joined(text)):
            known = memo.get(t)
            out += self._numbers(t) if known is None else known
        return out


def sentences(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(places, sentence of each place, classes of each sentence)`` of words as numbers: the
    places of the hashed n-grams of each sentence; n-grams don't cross a zero."""
    at = np.cumsum(words == 0)
    flags = np.zeros(int(at[-1]) + 1 if len(at) else 0, np.uint64)
    np.bitwise_or.at(flags, at, words & np.uint64((1 << _CLASS_BITS) - 1))
    hashes = words >> np.uint64(_CLASS_BITS)
    places, owner = [], []
    run = np.zeros(len(words), np.uint64)
    for n in range(1, LONGEST + 1):
        if len(words) < n:
            break
        run = run[: len(words) - n + 1] * _A + hashes[n - 1 :]
        # the first and the last word lie in one sentence and are no zeros
        whole = (words[: len(run)] != 0) & (words[n - 1 :] != 0) & (at[: len(run)] == at[n - 1 :])
        mixed = run[whole] * _B
        places.append((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(40) & np.uint64((1 << BITS) - 1))
        owner.append(at[: len(run)][whole])
    return np.concatenate(places or [np.empty(0, np.uint64)]).astype(np.int64), np.concatenate(owner or [np.empty(0, np.int64)]), flags.astype(np.int64)


_PAIRS = [(a, b) for a in range(len(CLASSES)) for b in range(a, len(CLASSES))]


def _held(flags: np.ndarray) -> np.ndarray:
    """Columns: always one, then each class and pair of classes that a sentence holds."""
    bit = (flags[:, None] >> np.arange(len(CLASSES)) & 1).astype(np.float64)
    return np.column_stack([np.ones(len(flags)), *(bit[:, a] * bit[:, b] for a, b in _PAIRS)])


def _prior() -> np.ndarray:
    known = {frozenset(k.split()): v for k, v in PRIOR.items()}
    return np.array([known[frozenset()], *(known.get(frozenset({CLASSES[a], CLASSES[b]}), 0.0) for a, b in _PAIRS)])


@dataclass
class Model:
    """Weights of n-grams and of classes; ``grams`` and ``learned`` are what restores texts."""

    grams: Grams = field(default_factory=Grams)
    learned: tuple[str, ...] = ()
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    classes: np.ndarray = field(default_factory=_prior)

    def restorer(self) -> Restorer:
        return Restorer(self.grams, self.learned)

    def scores(self, texts: list[list[int]]) -> np.ndarray:
        """Score of each text: that of its worst sentence; 0 where there is no word."""
        if not texts:
            return np.empty(0)
        sizes = np.array([len(t) + 1 for t in texts])
        words = np.fromiter((w for t in texts for w in (*t, 0)), np.uint64, int(sizes.sum()))
        places, owner, flags = sentences(words)
        table = _held(np.arange(1 << len(CLASSES))) @ self.classes
        z = table[flags] + np.bincount(owner, self.weights[places], len(flags))
        z[np.bincount(owner, minlength=len(flags)) == 0] = -np.inf
        # the sentence that a text begins in
        first = (np.cumsum(words == 0) - (words == 0))[np.cumsum(sizes) - sizes]
        return np.round(1 / (1 + np.exp(-np.maximum.reduceat(z, first))), 6)


#: Share of harmless texts that are labelled abusive by mistake.
MISTAKES = 0.006


def fitted(texts: list[list[int]], labels: np.ndarray, weight: float = 1.0, steps: int = 80, ridge: float = 0.05, rate: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """``(weights, classes)`` of a logistic model of sentences, fitted on labels of texts: a text is
    abusive if any of its sentences is, and some labels are mistaken. Each harmless text stands for
    ``weight`` of them. N-grams that stand in fewer than two sentences of abusive texts get no
    weight. Full-batch Adam steps from the prior, so the same labels always give the same model; no
    labels give the prior."""
    weights, prior = np.zeros(1 << BITS, np.float32), _prior()
    if not texts or not labels.any():
        return weights, prior
    sizes = np.array([len(t) + 1 for t in texts])
    words = np.fromiter((w for t in texts for w in (*t, 0)), np.uint64, int(sizes.sum()))
    places, owner, flags = sentences(words)
    # the sentence after a text's last zero is empty unless it is the last of all
    ends = np.cumsum(words == 0)[np.cumsum(sizes) - 1]
    text_of = np.minimum(np.searchsorted(ends, np.arange(len(flags)), side="right"), len(texts) - 1)
    bad = labels.astype(bool)
    often = np.bincount(places[bad[text_of[owner]]], minlength=1 << BITS) >= 2
    kept = often[places]
    places, owner = places[kept], owner[kept]
    names, columns = np.unique(places, return_inverse=True)
    held, shapes = np.unique(flags, return_inverse=True)
    held = _held(held)
    w, v = np.zeros(len(names)), prior.copy()
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, v)]
    for step in range(1, steps + 1):
        z = (held @ v)[shapes] + np.bincount(owner, w[columns], len(flags))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        harmless = np.exp(np.bincount(text_of, np.log1p(-p), len(texts)))
        pull = np.where(bad, (1 - MISTAKES) * harmless / (MISTAKES + (1 - MISTAKES) * (1 - harmless)), -weight)
        slope = -pull[text_of] * p
        grads = (
            np.bincount(columns, slope[owner], len(names)) + ridge * w,
            held.T @ np.bincount(shapes, slope, len(held)) + ridge * (v - prior),
        )
        for x, g, m in zip((w, v), grads, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            x -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6)
    weights[names] = w
    return weights, v


#: Weights are summed as whole numbers of this part, so that their order doesn't matter.
_UNIT = 1e-6


def fit_counts(df: DataFrame, text: str = "text") -> Grams:
    """The n-grams that the character model needs, over the distinct words of all texts, each
    word with the logarithm of its count as weight. Only n-grams reach the driver: their number
    is bounded by the alphabet, not by the table. A letter three times or more in a row counts once,
    else stretched words would teach the model that they are right. Letters that no known word can hold become one
    sign, which counts in totals but never as a history. No text gives none."""
    letters = "".join(sorted(frozenset(_ALPHABET).union(*_vocabulary())))
    words = df.where(F.length(text) > 0).select(
        F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}]{2,20})"), F.lit(1))).alias("w")
    )
    words = words.groupBy("w").count().select(F.regexp_replace("w", r"(\p{L})\1{2,}", "$1").alias("w"), "count")
    padded = F.concat(F.lit(_EDGE * (_ORDER - 1)), F.regexp_replace("w", f"[^{letters}]", _OTHER), F.lit(_EDGE))
    weighted = words.groupBy("w").agg(F.sum("count").alias("count")).select(padded.alias("p"), F.round(F.log1p("count") / _UNIT).cast("long").alias("weight"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, int] = {}
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k in range(_ORDER - 1, len(word)):
                    for start in range(k, k - _ORDER, -1):
                        if start < k and word[start] == _OTHER:
                            break
                        gram = word[start : k + 1]
                        held[gram] = held.get(gram, 0) + n
            total = sum(batch.column(1).to_pylist())
            # the empty one stands for the words themselves
            columns = [[*held, ""], [*held.values(), total], [*[0] * len(held), batch.num_rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["gram", "weight", "words"])

    summed = weighted.mapInArrow(grams, "gram string, weight long, words long").groupBy("gram").agg(
        F.sum("weight").alias("weight"), F.sum("words").alias("words")
    )
    out = Grams()
    for gram, weight, n in zip(*(c.to_pylist() for c in summed.toArrow().columns), strict=True):
        if gram:
            out[gram] = weight * _UNIT
        else:
            out.mean = weight * _UNIT / n
    return out


#: Most labelled rows of each kind that the classifier is fitted on, in the order of a hash of their
#: ids, and the longest text among them, in characters. All other counts are over all texts.
ABUSIVE_LABELS, HARMLESS_LABELS, LONGEST_LABELLED = 10_000, 10_000, 100_000
#: A word is learned if so many abusive texts hold it, and they are so large a part of all that do.
LEARNED_TEXTS, LEARNED_SHARE = 3, 0.3
#: Score from which on a text counts as abusive.
THRESHOLD = 0.3


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """The model of ``df``'s texts: n-grams of all of them, and a classifier fitted on the labels
    (``doc_id, toxic``) of at most ABUSIVE_LABELS and HARMLESS_LABELS texts.

    Null ids, labels and texts are left out, an id that is labelled twice counts as abusive if any
    of its labels says so. What comes to the driver is bounded by these parameters, the n-grams by
    the alphabet. Without labels the prior over the lexicon's classes scores alone.
    """
    grams = fit_counts(df, text)
    known = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(key).alias("key")).agg((F.max("toxic") > 0).alias("bad"))
    picked = [
        known.where(F.col("bad") if bad else ~F.col("bad")).orderBy(F.xxhash64("key"), "key").limit(most)
        for bad, most in ((True, ABUSIVE_LABELS), (False, HARMLESS_LABELS))
    ]
    texts = df.where(F.length(text).between(1, LONGEST_LABELLED)).select(F.col(key).alias("key"), F.col(text).alias("text"))
    # the sample's size is bounded by the two limits
    sample = cut(texts.join(F.broadcast(picked[0].unionByName(picked[1])), "key"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]{3,20})"), F.lit(1)))
    held = sample.select("bad", F.explode(words).alias("word")).groupBy("word").agg(F.count_if("bad").alias("bad"), F.count("*").alias("texts"))
    often = held.where((F.col("bad") >= LEARNED_TEXTS) & (F.col("bad") >= LEARNED_SHARE * F.col("texts"))).select("word")
    letters = frozenset(_ALPHABET).union(*_vocabulary())
    learned = tuple(sorted(r[0] for r in often.collect() if letters.issuperset(r[0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(Restorer(grams, learned))
        for batch in batches:
            lists = [np.array(read(x), np.uint64).view(np.int64) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int64()))], ["key", "bad", "words"])

    kind = sample.schema["key"].dataType.simpleString()
    rows = sample.select("key", "bad", "text").mapInArrow(run, f"key {kind}, bad boolean, words array<long>").toArrow().sort_by("key")
    lists = rows.column("words").combine_chunks()
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum([0, *lists.value_lengths().to_pylist()])
    bad = np.array(rows.column("bad").to_pylist(), bool)
    harmless = known.where(~F.col("bad")).count()
    weight = max(1.0, harmless / max(1, int((~bad).sum())))
    weights, classes = fitted([flat[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)], bad, weight)
    return Model(grams, learned, weights, classes)


def scores(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, *keep, score`` of each row's whole text, from 0 to 1: that of its worst sentence.
    Null and empty texts and texts without a word score 0. One row comes out per row that goes in,
    without a shuffle; only the fitted model goes to the workers."""
    names = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(model.restorer())
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                found = model.scores([read(x) if x else [] for x in batch.column(0).to_pylist()])
                columns = [batch.column(k + 1) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.float64())], [*(f"_{k}" for k in range(len(names))), "score"])

    rows = df.select(F.col(text).alias("_text"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(names)))
    kinds = ", ".join(f"_{k} {rows.schema[f'_{k}'].dataType.simpleString()}" for k in range(len(names)))
    return rows.mapInArrow(run, f"{kinds}, score double").toDF(*names, "score")


def rates(scored: DataFrame, threshold: float = THRESHOLD, source: str = "source") -> DataFrame:
    """``source, documents, abusive, rate`` of every source of scored rows, a null source included."""
    return (
        scored.groupBy(source)
        .agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= threshold).alias("abusive"))
        .withColumn("rate", F.round(F.col("abusive") / F.col("documents"), 6))
    )


def held_out(df: DataFrame, labels: DataFrame, parts: int = 5, by: str = "lang") -> DataFrame:
    """``lang, labelled, positive, flagged, both`` of the labelled texts of one part of ``parts`` (by a
    hash of the id) under a model that was fitted on the labels of the others."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0
    model = fit(df, labels.where(~part))
    asked = labels.where(part & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    flagged = F.col("score") >= THRESHOLD
    return scores(df.join(asked, "doc_id"), model, keep=(by, "toxic")).groupBy(by).agg(
        F.count("*").alias("labelled"), F.sum("toxic").cast("long").alias("positive"), F.count_if(flagged).alias("flagged"),
        F.count_if(flagged & (F.col("toxic") > 0)).alias("both"),
    )
