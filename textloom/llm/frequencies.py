"""Occurrences and records of every distinct term, by external sort and run lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

_RUNS = pa.schema([("term", pa.string()), ("df", pa.int64()), ("ttf", pa.int64())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run lengths of one sorted partition. The last pair of a batch waits for the next one,
    as it may go on there; a term that goes on gives another partial row."""
    waiting: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

    def counted(terms: pa.Array, starts: np.ndarray, fresh: np.ndarray, most: np.ndarray) -> pa.RecordBatch:
        heads = np.flatnonzero(fresh[starts])
        columns = [
            terms.take(pa.array(starts[heads])),
            pa.array(np.diff(np.append(heads, len(starts)))),
            pa.array(np.add.reduceat(most, heads)),
        ]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _RUNS, strict=True)], schema=_RUNS)

    for batch in batches:
        if not batch.num_rows:
            continue
        terms, docs, tfs = batch.column(0), *(batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
        if waiting:
            (term, doc, tf), waiting = waiting[0], []
            terms = pa.concat_arrays([term, terms])
            docs, tfs = np.concatenate([doc, docs]), np.concatenate([tf, tfs])
        n = len(docs)
        fresh = np.ones(n, bool)
        fresh[1:] = pc.not_equal(terms.slice(1), terms.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        pair = fresh.copy()
        pair[1:] |= docs[1:] != docs[:-1]
        starts = np.flatnonzero(pair)
        most = np.maximum.reduceat(tfs, starts)
        last = starts[-1]
        waiting = [(terms.slice(last, 1), docs[last : last + 1], most[-1:])]
        if len(starts) > 1:
            yield counted(terms, starts[:-1], fresh, most[:-1])
    for term, _, tf in waiting:
        yield counted(term, np.array([0]), np.array([True]), tf)


def value_frequencies(postings: DataFrame) -> DataFrame:
    """``term, df, ttf`` of every distinct term as stored, over ``term, doc_id, tf`` rows.

    Term and record pairs are range-partitioned and sorted, so that each pair lies in one
    partition while a term that holds a large share of the rows spreads over many; runs are
    counted in one pass, and a term's few partial counts are added up. Repeated pairs count
    once, with their larger ``tf``; a null ``tf`` is read off ``positions``. Rows without term
    or record are left out; the empty term is a term. Empty tables give no rows.
    """
    tf = F.coalesce(F.col("tf"), F.size("positions"))
    pairs = postings.where("term is not null and doc_id is not null").select(
        "term", F.col("doc_id").cast("long").alias("doc_id"), F.when(tf > 0, tf).otherwise(0).cast("long").alias("tf")
    )
    ordered = pairs.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    partial = ordered.mapInArrow(_runs, "term string, df long, ttf long")
    return partial.groupBy("term").agg(F.sum("df").alias("df"), F.sum("ttf").alias("ttf"))


def marked(frequencies: DataFrame, records: DataFrame, rare: int = 2, common: float = 0.2) -> DataFrame:
    """``term, df, ttf, mark``: 'rare' in at most ``rare`` records, else 'common' in more than
    the share ``common`` of all distinct records (those without terms included), else null."""
    n = records.where("doc_id is not null").select("doc_id").distinct().count()
    return frequencies.withColumn(
        "mark", F.when(F.col("df") <= rare, "rare").when(F.col("df") > F.lit(common * n), "common")
    )
