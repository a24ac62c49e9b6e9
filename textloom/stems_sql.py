"""The stemmer stated in SQL, for comparing results."""

from __future__ import annotations

from textloom.functions.words import STEPS


def _shape(w: str) -> str:
    """'v' or 'c' for each letter of a column."""
    step = "a || CASE WHEN c IN ('a', 'e', 'i', 'o', 'u') OR (c = 'y' AND right(a, 1) = 'c') THEN 'v' ELSE 'c' END"
    return f"list_reduce(list_prepend('', regexp_extract_all({w}, '(?s).')), lambda a, c: {step})"


def _measure(s: str) -> str:
    return f"((length({s}) - length(replace({s}, 'vc', ''))) // 2)"


def _short_end(w: str, s: str) -> str:
    return f"(right({s}, 3) = 'cvc' AND right({w}, 1) NOT IN ('w', 'x', 'y'))"


def _step(rules: list[tuple[str, str]], least: int) -> str:
    """The first suffix that fits, replaced if enough is left before it."""
    cases = " ".join(
        f"WHEN ends_with(w, '{a}') THEN CASE WHEN {_measure(f'left(s, length(w) - {len(a)})')} >= {least} THEN left(w, length(w) - {len(a)}) || '{b}' ELSE w END"
        for a, b in rules
    )
    return f"CASE {cases} ELSE w END"


def stems(source: str) -> str:
    """CTEs that end with ``stems(word, stem)`` for the distinct ``word`` column of ``source``."""
    past = f"""CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_measure("left(s, length(w) - 3)")} > 0 THEN left(w, length(w) - 1) ELSE w END
  WHEN k = 0 OR NOT contains(bs, 'v') THEN w WHEN right(b, 2) IN ('at', 'bl', 'iz') THEN b || 'e'
  WHEN length(b) > 1 AND right(b, 1) = left(right(b, 2), 1) AND right(bs, 1) = 'c' THEN CASE WHEN right(b, 1) IN ('l', 's', 'z') THEN b ELSE left(b, length(b) - 1) END
  WHEN {_measure("bs")} = 1 AND {_short_end("b", "bs")} THEN b || 'e' ELSE b END"""
    shorter = "left(s, length(w) - 1)"
    ctes = [
        f"""z0 AS (SELECT word, lower(word) AS w, length(word) + length(regexp_replace(word, '[^\\x{{10000}}-\\x{{10ffff}}]', '', 'g')) AS units
  FROM (SELECT DISTINCT word FROM {source} WHERE word IS NOT NULL))""",
        """z1 AS (SELECT word, CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN left(w, length(w) - 2)
  WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END AS w FROM z0 WHERE units > 2)""",
        f"""z2 AS (SELECT *, {_shape("w")} AS s, CASE WHEN ends_with(w, 'ed') THEN 2 WHEN ends_with(w, 'ing') THEN 3 ELSE 0 END AS k FROM z1)""",
        "z3 AS (SELECT *, left(w, length(w) - k) AS b, left(s, length(w) - k) AS bs FROM z2)",
        f"z4 AS (SELECT word, {past} AS w FROM z3)",
        f"z5 AS (SELECT *, {_shape('w')} AS s FROM z4)",
        f"z6 AS (SELECT word, CASE WHEN ends_with(w, 'y') AND contains({shorter}, 'v') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM z5)",
    ]
    n = 6
    for rules, least in STEPS:
        ctes += [f"z{n + 1} AS (SELECT word, w, {_shape('w')} AS s FROM z{n})", f"z{n + 2} AS (SELECT word, {_step(rules, least)} AS w FROM z{n + 1})"]
        n += 2
    ion = f"(ends_with(w, 'sion') OR ends_with(w, 'tion')) AND {_measure('left(s, length(w) - 3)')} > 1"
    ends = [
        f"CASE WHEN {ion} THEN left(w, length(w) - 3) ELSE w END",
        f"CASE WHEN ends_with(w, 'e') AND ({_measure(shorter)} > 1 OR ({_measure(shorter)} = 1 AND NOT {_short_end('left(w, length(w) - 1)', shorter)})) THEN left(w, length(w) - 1) ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {_measure('s')} > 1 THEN left(w, length(w) - 1) ELSE w END",
    ]
    for end in ends:
        ctes += [f"z{n + 1} AS (SELECT word, w, {_shape('w')} AS s FROM z{n})", f"z{n + 2} AS (SELECT word, {end} AS w FROM z{n + 1})"]
        n += 2
    ctes.append(f"stems AS MATERIALIZED (SELECT word, w AS stem FROM z{n} UNION ALL SELECT word, word FROM z0 WHERE units <= 2)")
    return ",\n".join(ctes)
