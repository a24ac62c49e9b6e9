"""From query text to a plan: resolve words against the lexicon, match and score in one pass."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.functions.analysis import analyze_text, normalize_term
from textloom.functions.snippets import snippet
from textloom.operators import ranking
from textloom.operators.index import Index
from textloom.plans.language import And, Fuzzy, Node, Not, Or, Phrase, Prefix, Term, parse

#: Fuzzy replacements of a word that isn't in the lexicon.
REPLACEMENTS = 3
#: Terms that are pushed into a scan as a list of values; more are joined.
PUSHED_TERMS = 400


@dataclass
class _Leaf:
    """One condition of a query: lexicon terms by value, by prefix or by distance, or a phrase."""

    node: Node
    terms: list[str] = field(default_factory=list)
    prefix: str | None = None
    near: tuple[str, int] | None = None
    phrase: list[str] | None = None
    scores: bool = False


@dataclass
class Plan:
    """A query with its leaves resolved. ``raw`` are the scoring strings in the order they
    occur, each with the lexicon term that it stands for; ``df`` are the frequencies of exact terms."""

    tree: Node
    leaves: list[_Leaf]
    raw: dict[str, tuple[int, str]]
    df: dict[str, int] = field(default_factory=dict)

    def exact(self) -> set[str]:
        found = {t for leaf in self.leaves for t in (leaf.terms + (leaf.phrase or []))}
        return found | {t for _, t in self.raw.values()}

    def open_leaves(self) -> list[tuple[int, _Leaf]]:
        return [(k, x) for k, x in enumerate(self.leaves) if x.prefix is not None or x.near]


def _walk(node: Node, scores: bool = True):
    if isinstance(node, And | Or):
        for child in node.children:
            yield from _walk(child, scores)
    elif isinstance(node, Not):
        yield from _walk(node.child, False)
    else:
        yield node, scores


def _distance(term: Column, target: str, most: int) -> Column:
    """Edit distance up to ``most``, else null; lengths are compared first."""
    d = F.levenshtein(F.lower(term), F.lit(target), most)
    return F.when((F.abs(F.length(term) - len(target)) <= most) & (d >= 0), d)


def _local(index: Index, schema: str, rows: list[tuple]) -> DataFrame:
    """Rows that the driver holds as a table whose size the optimizer knows."""
    spark = index.docs.sparkSession
    kind = to_arrow_schema(T._parse_datatype_string(schema))
    columns = list(zip(*rows, strict=True)) or [()] * len(kind)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind), schema)


def _near(index: Index, asked: DataFrame) -> DataFrame:
    """``asked`` (with ``target, most``) joined with the lexicon terms within ``most`` edits, and
    their distance ``d``. Lengths that can match are equal keys, so the lexicon is read once for
    all words, however many there are."""
    sizes = F.sequence(F.greatest(F.lit(0), F.length("target") - F.col("most")), F.length("target") + F.col("most"))
    words = asked.withColumn("_size", F.explode(sizes))
    terms = index.terms.select("term", "df", F.length("term").alias("_size"))
    d = F.expr("levenshtein(lower(term), target, most)")
    # what the driver held before isn't large for an executor
    return terms.join(F.broadcast(words), "_size").withColumn("d", d).where("d >= 0").drop("_size")


def _target(word: str, index: Index) -> str:
    return (normalize_term(word, index.config) or word).lower()


def resolve(index: Index, queries: dict[object, Node], fuzzy: bool | int = True) -> dict[object, Plan]:
    """Resolve all words of a batch with one job on the lexicon, plus one for words that need
    replacements. What comes to the driver is bounded by the words of the queries: prefix and
    fuzzy expansions stay conditions on the lexicon.

    A word stands for the lexicon term it equals, else for its normal form. A TERM that has
    neither, of three UTF-16 units or more, is replaced by the nearest terms (distance up to 2
    from six units on, else 1, or the number given for ``fuzzy``): those of the least distance,
    the first three in collation order.
    """
    words: set[str] = set()
    for tree in queries.values():
        for node, _ in _walk(tree):
            if isinstance(node, Term):
                words.add(node.value)
            elif isinstance(node, Fuzzy):
                words.add(node.term)
            elif isinstance(node, Phrase):
                words.update(node.words)
                words.update(t for t, *_ in analyze_text(" ".join(node.words), index.config))
    forms = {w: normalize_term(w, index.config) for w in words}
    asked = sorted(words | set(forms.values()))
    known: dict[str, int] = {}
    if asked:
        here = index.terms.select("term", "df")
        if len(asked) <= PUSHED_TERMS:
            here = here.where(F.col("term").isin(asked))
        else:
            here = here.join(F.broadcast(_local(index, "term string", [(w,) for w in asked])), "term")
        known = dict(map(tuple, here.collect()))

    def stands_for(word: str) -> str | None:
        form = forms.get(word, word)
        return word if word in known else form if form in known else None

    missing: dict[str, tuple[str, int]] = {}
    for tree in queries.values():
        for node, _ in _walk(tree):
            if isinstance(node, Term) and not stands_for(node.value) and fuzzy is not False:
                size = len(node.value.encode("utf-16-le", "surrogatepass")) // 2
                if size >= 3:
                    most = (2 if size >= 6 else 1) if fuzzy is True else int(fuzzy)
                    missing[node.value] = (_target(node.value, index), most)
    nearest: dict[str, list[str]] = {}
    if missing:
        hits = _near(index, _local(index, "word string, target string, most int", [(w, t, n) for w, (t, n) in missing.items()]))
        rows = ranking.top_each(
            hits.select("word", "d", "term", "df", F.collate("term", "UNICODE").alias("_order")).withColumn(
                "score", -F.col("d")
            ),
            "word", REPLACEMENTS, tie="_order",
        ).select("word", "d", "term", "df", "rank").collect()
        least: dict[str, int] = {}
        for r in sorted(rows, key=lambda r: r["rank"]):
            if r["d"] == least.setdefault(r["word"], r["d"]):
                nearest.setdefault(r["word"], []).append(r["term"])
                known[r["term"]] = r["df"]

    plans = {}
    for key, tree in queries.items():
        leaves: list[_Leaf] = []
        raw: dict[str, tuple[int, str]] = {}

        def score(word: str, term: str | None, raw: dict[str, tuple[int, str]] = raw) -> None:
            if term is not None:
                raw.setdefault(word, (len(raw), term))

        for node, scores in _walk(tree):
            leaf = _Leaf(node, scores=scores)
            if isinstance(node, Term):
                term = stands_for(node.value)
                leaf.terms = [term] if term else nearest.get(node.value, [])
                if scores:
                    for t in leaf.terms:
                        score(node.value if term else t, t)
            elif isinstance(node, Fuzzy):
                leaf.near = (_target(node.term, index), node.distance)
                if scores:
                    score(node.term, None)
            elif isinstance(node, Prefix):
                leaf.prefix = node.prefix.lower()
            else:
                leaf.phrase = [t for t, *_ in analyze_text(" ".join(node.words), index.config)]
                if scores:
                    for w in node.words:
                        score(w, stands_for(w))
            leaves.append(leaf)
        plans[key] = Plan(tree, leaves, raw)
    for plan in plans.values():
        plan.df = {t: known[t] for t in plan.exact() if t in known}
    return plans


ROWS = "qid int, term string, df long, leaves array<int>, raw array<struct<at:int,raw:string>>"


def _exact_rows(plans: dict[object, Plan]) -> list[tuple]:
    out = []
    for number, plan in enumerate(plans.values()):
        leaves: dict[str, list[int]] = {}
        strings: dict[str, list[dict]] = {}
        for k, leaf in enumerate(plan.leaves):
            for t in leaf.terms:
                leaves.setdefault(t, []).append(k)
        for word, (at, t) in plan.raw.items():
            strings.setdefault(t, []).append({"at": at, "raw": word})
        out += [(number, t, df, leaves.get(t, []), strings.get(t, [])) for t, df in sorted(plan.df.items())]
    return out


def _term_rows(index: Index, plans: dict[object, Plan]) -> tuple[DataFrame, list[str] | None]:
    """``qid, term, df, leaves, raw`` of every lexicon term that a query needs: the leaves it
    satisfies and the scoring strings (place, string) that stand for it; and these terms, if they
    are few. Exact terms are known since they were resolved; prefixes and distances of all queries
    are two tables that are joined to the lexicon."""
    exact = _exact_rows(plans)
    prefixes, near = [], []
    for number, plan in enumerate(plans.values()):
        for k, leaf in plan.open_leaves():
            at = len(plan.raw) + k if leaf.scores else None
            if leaf.prefix is not None:
                prefixes.append((number, k, at, leaf.prefix))
            else:
                near.append((number, k, at, *leaf.near))
    rows = _local(index, ROWS, exact)
    if not prefixes and not near:
        terms = sorted({r[1] for r in exact})
        return rows, terms if len(terms) <= PUSHED_TERMS else None
    hits = []
    if prefixes:
        lengths = F.array(*map(F.lit, sorted({len(p[3]) for p in prefixes})))
        pieces = F.transform(F.filter(lengths, lambda n: n <= F.length("term")), lambda n: F.left("term", n))
        asked = _local(index, "qid int, leaf int, at int, prefix string", prefixes)
        hits.append(index.terms.select("term", "df", F.explode(pieces).alias("prefix")).join(F.broadcast(asked), "prefix"))
    if near:
        hits.append(_near(index, _local(index, "qid int, leaf int, at int, target string, most int", near)))
    columns = ["qid", "term", "df", "leaf", "at"]
    opened = hits[0].select(*columns) if len(hits) == 1 else hits[0].select(*columns).unionByName(hits[1].select(*columns))
    own = F.when(F.col("at").isNotNull(), F.array(F.struct("at", F.col("term").alias("raw")))).otherwise(F.array())
    said = F.sort_array(F.flatten(F.collect_list("raw")))
    rows = (
        opened.select("qid", "term", "df", F.array("leaf").alias("leaves"), own.cast("array<struct<at:int,raw:string>>").alias("raw"))
        .unionByName(rows)
        .groupBy("qid", "term")
        .agg(F.max("df").alias("df"), F.flatten(F.collect_list("leaves")).alias("leaves"), said.alias("raw"))
    )
    # a string scores a term once, at its first place
    first = F.filter("raw", lambda x, k: ~F.exists(F.slice("raw", F.lit(1), k), lambda y: y["raw"] == x["raw"]))
    rows = rows.withColumn("raw", first)
    some = rows.limit(PUSHED_TERMS + 1).collect()
    if len(some) > PUSHED_TERMS:
        return rows, None
    rows = _local(index, ROWS, [(r[0], r[1], r[2], r[3], [x.asDict() for x in r[4]]) for r in some])
    return rows, sorted({r[1] for r in some})


def _pushed(index: Index, rows: DataFrame, terms: list[str] | None) -> DataFrame:
    """Postings joined with the rows of their terms. Few terms are pushed into the scan; for
    many the postings are read once, and a frequent term is no hot key: its row is broadcast, or
    its side is split while the join runs."""
    if terms is None:
        return index.postings.join(rows, "term")
    return index.postings.where(F.col("term").isin(terms) if terms else F.lit(False)).join(F.broadcast(rows), "term")


def _within(at: Column, slop: int):
    return lambda y: (y > at) & (y <= at + 1 + slop)


def phrase_starts(positions: list[Column], slop: int = 0) -> Column:
    """Start positions at which the terms follow each other: adjacent for slop 0, else each at
    the nearest place after the one before it with at most ``slop`` words between them, without
    going back to try a farther one. A single term starts wherever it stands."""
    first, *others = positions
    if not others:
        return first
    if slop == 0:
        keep = lambda p: _all(F.array_contains(x, p + k + 1) for k, x in enumerate(others))
        return F.filter(first, keep)

    def chained(p: Column) -> Column:
        at = p
        for x in others:
            at = F.array_min(F.filter(x, _within(at, slop)))
        return at.isNotNull()

    return F.filter(first, chained)


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out if out is not None else F.lit(True)


def _matches(plan: Plan, met: Column, places: Column) -> Column:
    leaf_at = iter(range(len(plan.leaves)))

    def condition(node: Node) -> Column:
        if isinstance(node, And):
            return _all(condition(c) for c in node.children) if node.children else F.lit(False)
        if isinstance(node, Or):
            out = F.lit(False)
            for c in node.children:
                out = out | condition(c)
            return out
        if isinstance(node, Not):
            return ~condition(node.child)
        k = next(leaf_at)
        if not isinstance(node, Phrase):
            return F.array_contains(met, k)
        terms = plan.leaves[k].phrase or []
        if not terms:
            return F.lit(False)
        lists = [F.coalesce(F.try_element_at(places, F.lit(t)), F.array().cast("array<int>")) for t in terms]
        return F.size(phrase_starts(lists, node.slop)) > 0

    return condition(plan.tree)


_NOT, _AND, _OR, _NEVER = -1, -2, -3, -4


def _program(plan: Plan) -> list[int]:
    """The condition of a query in postfix order: a leaf's number, or what joins those before."""
    leaf_at = iter(range(len(plan.leaves)))

    def code(node: Node) -> list[int]:
        if isinstance(node, And | Or):
            parts = [code(c) for c in node.children]
            if not parts:
                return [_NEVER]
            return [*parts[0], *(x for p in parts[1:] for x in (*p, _AND if isinstance(node, And) else _OR))]
        if isinstance(node, Not):
            return [*code(node.child), _NOT]
        return [next(leaf_at)]

    return code(plan.tree)


def _holds(program: Column, met: Column) -> Column:
    """Whether a condition holds where the leaves ``met`` are; one expression for all queries."""

    def step(stack: Column, op: Column) -> Column:
        top, under = F.element_at(stack, -1), F.try_element_at(stack, F.lit(-2))
        push = lambda rest, x: F.concat(rest, F.array(x))
        drop = lambda n: F.slice(stack, F.lit(1), F.greatest(F.size(stack) - n, F.lit(0)))
        return (
            F.when(op >= 0, push(stack, F.array_contains(met, op)))
            .when(op == _NEVER, push(stack, F.lit(False)))
            .when(op == _NOT, push(drop(1), ~top))
            .when(op == _AND, push(drop(2), top & under))
            .otherwise(push(drop(2), top | under))
        )

    return F.coalesce(F.element_at(F.aggregate(program, F.array(F.lit(False)), step), -1), F.lit(False))


def _phrase_leaves(phrases: Column, places: Column) -> Column:
    """Leaves of the ``phrases`` (leaf, slop, terms) of a query that stand in ``places``."""
    empty = F.array().cast("array<int>")

    def stands(p: Column) -> Column:
        lists = F.transform(p["terms"], lambda t: F.coalesce(F.try_element_at(places, t), empty))
        rest = F.slice(lists, F.lit(2), F.greatest(F.size(lists) - 1, F.lit(0)))
        chained = lambda start: F.aggregate(
            rest, start, lambda at, y: F.array_min(F.filter(y, lambda x: (x > at) & (x <= at + 1 + p["slop"])))
        )
        return F.exists(F.coalesce(F.try_element_at(lists, F.lit(1)), empty), lambda start: chained(start).isNotNull())

    return F.transform(F.filter(phrases, stands), lambda p: p["leaf"])


def search_batch(
    index: Index, queries: dict[object, str | Node], *, limit: int | None = 10, fuzzy: bool | int = True, scorer: str = "bm25",
    k1: float | None = None, b: float | None = None, digits: int | None = None, resolved: dict[object, Plan] | None = None,
) -> DataFrame:
    """Run many queries in one job: ``qid, doc_id, score, matched_terms, rank``.

    The lexicon terms of all queries are joined to the postings, once, and one aggregation by
    query and document gives the leaves met, the score and the positions that phrases need. The
    queries themselves are a table: their conditions and phrases are joined to the groups, so the
    plan is the same for one query and for thousands.
    Every returned document has a positive score, so it has a posting of a scoring term; that
    is why one aggregation is enough even with NOT, and why a query of NOT alone finds nothing.
    Ties go to the smaller id; ``digits`` rounds scores before ranking; ``limit`` None keeps all.
    ``resolved`` are plans of the same queries made before.
    """
    plans = resolved or resolve(index, {q: parse(t) if isinstance(t, str) else t for q, t in queries.items()}, fuzzy)
    total = index.totals()
    n, average = F.lit(float(total["n"])), F.lit(float(total["avg"]))
    rows, terms = _term_rows(index, plans)
    phrased = sorted({t for p in plans.values() for x in p.leaves for t in (x.phrase or [])})
    k1, b = index.k1 if k1 is None else k1, index.b if b is None else b
    if scorer == "bm25":
        one = ranking.bm25(F.col("tf"), F.col("length"), average, ranking.bm25_idf(F.col("df"), n), k1, b)
    else:
        one = ranking.tfidf(F.col("tf"), F.col("length"), ranking.tfidf_idf(F.col("df"), n))
    aggregates = [
        F.array_distinct(F.flatten(F.collect_list("leaves"))).alias("met"),
        F.sum(one * F.size("raw")).alias("score"),
        F.sort_array(F.flatten(F.collect_list("raw"))).alias("said"),
    ]
    if phrased:
        needed = F.col("term").isin(phrased) if len(phrased) <= PUSHED_TERMS else F.lit(True)
        aggregates.append(F.map_from_entries(F.collect_list(F.when(needed, F.struct("term", "positions")))).alias("places"))
    grouped = _pushed(index, rows, terms).groupBy("qid", "doc_id").agg(*aggregates).where("score > 0")
    if len(plans) == 1:
        (plan,) = plans.values()
        places = F.col("places") if phrased else F.lit(None).cast("map<string,array<int>>")
        hits = grouped.where(_matches(plan, F.col("met"), places))
    else:
        asked = [
            (number, _program(p), [{"leaf": k, "slop": x.node.slop, "terms": x.phrase} for k, x in enumerate(p.leaves) if x.phrase])
            for number, p in enumerate(plans.values())
        ]
        conditions = _local(index, "qid int, program array<int>, phrases array<struct<leaf:int,slop:int,terms:array<string>>>", asked)
        met = F.concat("met", _phrase_leaves(F.col("phrases"), F.col("places"))) if phrased else F.col("met")
        hits = grouped.join(F.broadcast(conditions), "qid").withColumn("met", met).where(_holds(F.col("program"), F.col("met")))
    score = F.round("score", digits) if digits is not None else F.col("score")
    hits = hits.select("qid", "doc_id", score.alias("score"), F.transform("said", lambda x: x["raw"]).alias("matched_terms"))
    if limit is not None and len(plans) > 1:
        hits = ranking.top_each(hits, "qid", limit)
    elif limit is not None:
        hits = ranking.top(hits, limit)
    names = list(plans)
    if names != list(range(len(names))):
        kind = "long" if all(isinstance(x, int) for x in names) else "string"
        named = _local(index, f"qid int, name {kind}", [(k, x if kind == "long" else str(x)) for k, x in enumerate(names)])
        hits = hits.join(F.broadcast(named), "qid").drop("qid").withColumnRenamed("name", "qid").select("qid", *[c for c in hits.columns if c != "qid"])
        if limit is not None and len(plans) == 1:
            hits = ranking.top(hits, limit)
    return hits


def search(
    index: Index, query: str | Node, *, limit: int | None = 10, fuzzy: bool | int = True, highlight: bool = True,
    snippet_length: int = 150, fields: bool = False, **scoring,
) -> DataFrame:
    """``doc_id, score, matched_terms`` of the best matches, with a highlighted ``snippet``
    where the index has stored fields; ``fields`` adds these. Only the best rows are joined
    with the documents."""
    tree = parse(query) if isinstance(query, str) else query
    resolved = resolve(index, {0: tree}, fuzzy)
    hits = search_batch(index, {0: tree}, limit=limit, resolved=resolved, **scoring).drop("qid")
    stored = [c for c in index.docs.columns if c not in ("doc_id", "length")]
    source = [c for c in ("body", "text", "content", "title") if c in stored and dict(index.docs.dtypes)[c] == "string"]
    if not (highlight and source or fields):
        return hits
    wanted = stored if fields else source
    out = hits.join(index.docs.select("doc_id", *(F.col(c).alias(f"_f_{c}") for c in wanted)), "doc_id")
    if highlight and source:
        text = F.coalesce(*(F.when(F.length(f"_f_{c}") > 0, F.col(f"_f_{c}")) for c in source))
        out = out.withColumn("snippet", snippet(text, scoring_strings(resolved[0]), F.col("matched_terms"), snippet_length))
    keep = [F.col(f"_f_{c}").alias(c) for c in stored if fields]
    shown = [F.col("snippet")] if highlight and source else []
    result = out.select("doc_id", "score", "matched_terms", *shown, *keep)
    return ranking.top(result, limit) if limit is not None else result


def scoring_strings(plan: Plan) -> list[str]:
    """Scoring strings of a query that are known before the lexicon's expansions."""
    out: dict[str, None] = {}
    for leaf in plan.leaves:
        if not leaf.scores:
            continue
        node = leaf.node
        if isinstance(node, Term):
            own = leaf.terms and node.value not in plan.raw
            out.update(dict.fromkeys(leaf.terms if own else [node.value]))
        elif isinstance(node, Phrase):
            out.update(dict.fromkeys(node.words))
    return list(out)


# Sets of documents ----------------------------------------------------------------------


def boolean_and(index: Index, words: list[str]) -> DataFrame:
    """``doc_id`` of documents with all words; none if one is unknown; no fuzzy replacement."""
    plan = resolve(index, {0: And(tuple(map(Term, words)))}, fuzzy=False)[0]
    terms = {t for leaf in plan.leaves for t in leaf.terms}
    known = bool(words) and all(leaf.terms for leaf in plan.leaves)
    hits = index.postings.where(F.col("term").isin(sorted(terms)) if known else F.lit(False))
    return hits.groupBy("doc_id").agg(F.count_distinct("term").alias("k")).where(F.col("k") == len(terms)).select("doc_id")


def boolean_or(index: Index, words: list[str]) -> DataFrame:
    """``doc_id`` of documents with any of the words."""
    plan = resolve(index, {0: And(tuple(map(Term, words)))}, fuzzy=False)[0]
    terms = sorted({t for leaf in plan.leaves for t in leaf.terms})
    return index.postings.where(F.col("term").isin(terms) if terms else F.lit(False)).select("doc_id").distinct()


def matching(index: Index, query: str | Node, fuzzy: bool | int = True) -> DataFrame:
    """``doc_id`` of the documents for which a query holds, whatever their score; NOT is the
    complement in all documents."""
    tree = parse(query) if isinstance(query, str) else query
    plan = resolve(index, {0: tree}, fuzzy)[0]
    rows, terms = _term_rows(index, {0: plan})
    phrased = sorted({t for x in plan.leaves for t in (x.phrase or [])})
    grouped = (
        _pushed(index, rows, terms)
        .groupBy("doc_id")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("leaves"))).alias("met"),
            F.map_from_entries(F.collect_list(F.when(F.col("term").isin(phrased or [""]), F.struct("term", "positions")))).alias("places"),
        )
    )
    every = index.docs.select("doc_id").join(grouped, "doc_id", "left")
    met = F.coalesce("met", F.array().cast("array<int>"))
    places = F.coalesce("places", F.create_map().cast("map<string,array<int>>"))
    return every.where(_matches(plan, met, places)).select("doc_id")


def phrase_matches(index: Index, phrase: str, slop: int = 0) -> DataFrame:
    """``doc_id, match_positions`` (starts) of a phrase, which is analysed like a text."""
    terms = [t for t, *_ in analyze_text(phrase, index.config)]
    if not terms:
        return index.postings.where(F.lit(False)).select("doc_id", F.col("positions").alias("match_positions"))
    grouped = (
        index.postings.where(F.col("term").isin(sorted(set(terms))))
        .groupBy("doc_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("places"))
        .where(F.size("places") == len(set(terms)))
    )
    starts = phrase_starts([F.col("places")[t] for t in terms], slop)
    return grouped.select("doc_id", starts.alias("match_positions")).where(F.size("match_positions") > 0)


def fuzzy_terms(index: Index, word: str, distance: int = 2) -> DataFrame:
    """``term, df, ttf, distance`` of lexicon terms near a word, nearest first."""
    d = _distance(F.col("term"), _target(word, index), distance)
    return index.terms.withColumn("distance", d).where("distance is not null").orderBy("distance", F.collate("term", "UNICODE"))


def prefix_terms(index: Index, prefix: str) -> DataFrame:
    return index.terms.where(F.col("term").startswith(prefix.lower()))


def suggest(index: Index, prefix: str, limit: int = 5) -> DataFrame:
    """``term, df``: the most frequent lexicon terms with a prefix; none for the empty prefix."""
    hits = prefix_terms(index, prefix) if prefix else index.terms.where(F.lit(False))
    return hits.select("term", "df").orderBy(F.desc("df"), F.collate("term", "UNICODE")).limit(limit)


def wand(index: Index, words: list[str], limit: int = 10, **scoring) -> DataFrame:
    """The best documents for any of the words: what dynamic pruning gives exactly. Partitions
    keep ``limit`` rows each, so there is nothing left to prune."""
    return search_batch(index, {0: Or(tuple(map(Term, words)))}, limit=limit, fuzzy=False, **scoring).drop("qid")


def stop_words_only(query: str) -> bool:
    """Whether all plain words of a query are stop words: why it finds nothing."""
    import re

    from textloom.functions.words import STOP_WORDS

    words = re.findall(r"[a-z0-9_]+", query.lower())
    return bool(words) and all(w in STOP_WORDS for w in words)
