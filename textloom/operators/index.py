"""Index tables: documents, positional postings, lexicon, statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.functions.analysis import AnalyzerConfig, text_of, tokens
from textloom.operators.numbering import ranked
from textloom.plans.session import cut, written

POSTINGS = "term string, doc_id long, tf int, positions array<int>, length int"


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of each document. A document's tokens lie in one row, so the grouping by term
    and document needs no shuffle: tokens are coded, sorted by row and code, and cut in runs."""
    names = ["term", "doc_id", "tf", "positions", "length"]
    for whole in batches:
        for start in range(0, whole.num_rows, 512):
            batch = whole.slice(start, 512)
            lists = batch.column(1)
            flat = lists.flatten()
            if not len(flat):
                continue
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = flat.dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            positions = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            order = np.argsort(rows * (codes.max() + 1) + codes, kind="stable")
            r, c, p = rows[order], codes[order], positions[order]
            heads = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1])])
            tf = np.diff(np.r_[heads, len(r)])
            yield pa.RecordBatch.from_arrays(
                [
                    coded.dictionary.take(pa.array(c[heads])).cast(pa.string()),
                    batch.column(0).take(pa.array(r[heads])),
                    pa.array(tf.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.r_[heads, len(r)].astype(np.int32)), pa.array(p.astype(np.int32))),
                    pa.array(sizes[r[heads]].astype(np.int32)),
                ],
                names,
            )


@dataclass
class Index:
    """``docs`` (doc_id, length and the stored fields), ``postings`` (term, doc_id, tf,
    positions, length of the document) and what was used to make them."""

    docs: DataFrame
    postings: DataFrame
    config: AnalyzerConfig = field(default_factory=AnalyzerConfig)
    k1: float = 1.2
    b: float = 0.75
    lexicon: DataFrame | None = None
    #: Whether the tables are read from files rather than worked out anew by every job.
    written: bool = False
    #: The row of ``stats``, if it was stored.
    stored_stats: DataFrame | None = None
    _totals: dict | None = None

    @property
    def terms(self) -> DataFrame:
        """``term, df, ttf``."""
        return self.lexicon if self.lexicon is not None else term_stats(self.postings)

    def stats(self) -> DataFrame:
        return corpus_stats(self.docs, self.terms)

    def totals(self) -> dict:
        """Number of documents and their average length, worked out or read once."""
        if self._totals is None:
            if self.stored_stats is not None:
                row = self.stored_stats.select(F.col("total_documents").alias("n"), F.col("average_doc_length").alias("avg")).first()
            else:
                row = self.docs.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg")).first()
            self._totals = row.asDict()
        return self._totals

    def checkpointed(self) -> Index:
        """The same index with its tables written once below the shared folder."""
        postings = written(self.postings)
        return Index(cut(self.docs), postings, self.config, self.k1, self.b, written(term_stats(postings)), True)


class DuplicateIds(ValueError):
    """A document id that comes twice or is taken."""


def check_ids(docs: DataFrame, taken: DataFrame | None = None, key: str = "doc_id") -> None:
    """Raise DuplicateIds if an id repeats or is in ``taken``; nothing is written before."""
    again = docs.groupBy(key).count().where("count > 1").select(key)
    if taken is not None:
        again = again.unionByName(docs.select(key).join(taken.select(key), key, "left_semi"))
    if row := again.limit(1).collect():
        raise DuplicateIds(f"document {row[0][0]} already exists")


def build_index(
    df: DataFrame, config: AnalyzerConfig | None = None, *, key: str = "doc_id", text: Column | None = None,
    store_fields: bool = True, check: bool = True, k1: float = 1.2, b: float = 0.75,
) -> Index:
    """Index the rows of ``df``; the text follows ``text_of`` unless given.

    One pass without a shuffle per table: filters, tokens, bounds and stop words run in the
    JVM, which is all that ``docs`` needs; stems and the inversion run in Arrow functions. Documents without tokens stay in ``docs``
    with length 0. Rows with a null id are left out; ids that repeat raise DuplicateIds.
    """
    config = config or AnalyzerConfig()
    df = df.where(F.col(key).isNotNull())
    if check:
        check_ids(df, key=key)
    source = text if text is not None else text_of([(n, t) for n, t in df.dtypes if n != key], key)
    listed = df.withColumn("_tokens", tokens(source, config))
    fields = [F.col(f"`{c}`") for c in df.columns if c not in (key, "length")] if store_fields else []
    kept = F.size(tokens(source, replace(config, stemming=False)))  # a stem for each word
    docs = df.select(F.col(key).cast("long").alias("doc_id"), kept.alias("length"), *fields)
    pairs = listed.select(F.col(key).cast("long").alias("doc_id"), "_tokens")
    return Index(docs, pairs.mapInArrow(_invert, POSTINGS), config, k1, b)


def term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("ttf"))


def corpus_stats(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """One row ``total_documents, total_terms, total_tokens, average_doc_length`` (0 if empty)."""
    d = docs.agg(F.count("*").alias("total_documents"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_tokens"))
    t = terms.agg(F.count("*").alias("total_terms"))
    average = F.when(F.col("total_documents") > 0, F.col("total_tokens") / F.col("total_documents")).otherwise(0.0)
    # two one-row tables, joined on a constant
    joined = d.withColumn("_one", F.lit(1)).join(t.withColumn("_one", F.lit(1)), "_one")
    return joined.select("total_documents", "total_terms", "total_tokens", average.alias("average_doc_length"))


def skip_pointers(postings: DataFrame) -> DataFrame:
    """``term, posting_index, target_index, target_doc_id``: in lists of more than three
    postings, every floor(sqrt(n))-th posting points as many places on."""
    counts = postings.groupBy("term").agg(F.floor(F.sqrt(F.count("*"))).cast("int").alias("step")).where("step > 1")
    placed = (
        ranked(postings.select("term", "doc_id"), ["term"], ["doc_id"], "at")
        .join(counts, "term")
        .select("term", "doc_id", F.col("at").cast("int").alias("at"), "step")
        .where(F.col("at") % F.col("step") == 0)
    )
    # of n postings only about sqrt(n) are left
    following = Window.partitionBy("term").orderBy("at")
    return (
        placed.select(
            "term", F.col("at").alias("posting_index"), F.lead("at").over(following).alias("target_index"),
            F.lead("doc_id").over(following).alias("target_doc_id"),
        ).where("target_index is not null")
    )


# Segments -------------------------------------------------------------------------------


def merged(one: Index, other: Index) -> Index:
    """Both indexes as one, without analysing or rewriting anything: their documents are disjoint,
    so tables are appended and frequencies added."""
    terms = one.terms.unionByName(other.terms).groupBy("term").agg(F.sum("df").alias("df"), F.sum("ttf").alias("ttf"))
    docs = one.docs.unionByName(other.docs, allowMissingColumns=True)
    postings = one.postings.unionByName(other.postings)
    return Index(docs, postings, one.config, one.k1, one.b, terms, one.written and other.written)


def without(index: Index, ids: DataFrame, key: str = "doc_id") -> Index:
    """The index without the documents in ``ids``: their rows are passed by, and what they counted
    for is taken off the frequencies. Nothing is rewritten before the index is saved."""
    gone = ids.select(F.col(key).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    less = term_stats(index.postings.join(gone, "doc_id", "left_semi")).select("term", F.col("df").alias("_df"), F.col("ttf").alias("_ttf"))
    left = lambda c: (F.col(c) - F.coalesce(f"_{c}", F.lit(0))).alias(c)
    terms = index.terms.join(less, "term", "left").select("term", left("df"), left("ttf")).where("df > 0")
    off = lambda t: t.join(gone, "doc_id", "left_anti")
    return Index(off(index.docs), off(index.postings), index.config, index.k1, index.b, terms, index.written)


# Views of one index ---------------------------------------------------------------------


def postings_of(index: Index, term: str) -> DataFrame:
    """Postings of a term as it stands in the lexicon, else of its normal form."""
    from textloom.functions.analysis import normalize_term

    normal = normalize_term(term, index.config)
    here = index.postings.where(F.col("term").isin([term, normal]))
    direct = here.where(F.col("term") == term)
    if direct.limit(1).count():
        return direct.orderBy("doc_id")
    return here.where(F.col("term") == normal).orderBy("doc_id")


def posting_for_doc(index: Index, term: str, doc_id: int) -> DataFrame:
    return postings_of(index, term).where(F.col("doc_id") == doc_id)


def all_documents(index: Index) -> DataFrame:
    return index.docs


def document(index: Index, doc_id: int) -> DataFrame:
    return index.docs.where(F.col("doc_id") == doc_id)


def document_ids(index: Index) -> DataFrame:
    return index.docs.select("doc_id")


def lexicon_sorted(index: Index) -> DataFrame:
    return index.terms.orderBy("term")


def upsert(index_docs: DataFrame, changed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with the rows of ``changed`` in place of those with the same id."""
    return index_docs.join(changed.select(key), key, "left_anti").unionByName(changed, allowMissingColumns=True)


def delete(index_docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return index_docs.join(ids.select(key), key, "left_anti")
