"""The analysis as SQL functions of a session: ``stem``, ``fold``, ``normalize_term`` and the table
function ``tokenize``."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession, functions as F, types as T

from textloom.functions.analysis import AnalyzerConfig, analyze_text, normalize_term
from textloom.functions.words import stem, strip_marks


def _column(f):
    def run(words: pa.Array) -> pa.Array:
        coded = words.dictionary_encode()
        return pa.array([None if w is None else f(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)

    return F.arrow_udf(run, T.StringType())


def register(spark: SparkSession, config: AnalyzerConfig | None = None) -> None:
    """Make the functions known to ``spark.sql``; nulls give null, and no tokens."""
    config = config or AnalyzerConfig()
    spark.udf.register("stem", _column(stem))
    spark.udf.register("fold", _column(lambda text: strip_marks(text).lower()))
    spark.udf.register("normalize_term", _column(lambda term: normalize_term(term, config)))

    class Tokenize:
        def eval(self, text: str):
            yield from analyze_text(text or "", config)

    kinds = "term string, position int, start_offset int, end_offset int"
    spark.udtf.register("tokenize", F.udtf(Tokenize, returnType=kinds))
