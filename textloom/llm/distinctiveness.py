"""How distinctive a term is of a record: positive pointwise mutual information."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textloom.plans.session import written


def distinct_postings(postings: DataFrame) -> DataFrame:
    """One row ``(term, doc_id, tf)`` for each term of each record.

    Repeated rows count once (the larger ``tf`` holds where they differ). A null ``tf`` is
    read off ``positions``; rows without term or record are no postings and are left out.
    """
    tf = F.coalesce(F.col("tf"), F.size("positions").cast("int"))
    return (
        postings.where("term is not null and doc_id is not null")
        .groupBy("term", "doc_id")
        .agg(F.max(F.when(tf > 0, tf).otherwise(0)).cast("long").alias("tf"))
    )


#: A term that holds this part of all postings or more is hot; there are at most so many as its inverse.
HOT_SHARE = 0.001


def ppmi(postings: DataFrame, records: DataFrame, exponent: float = 0.75) -> DataFrame:
    """Score every term of every record.

    ``pmi = ln(p(t, d) / (p(t) * p_s(d)))`` where ``p(t, d)`` and ``p(t)`` come from the counts
    and the context's (record's) probability is smoothed to ``n_d ** exponent / sum(n_d **
    exponent)``, which keeps short records from taking all the score; ``ppmi = max(0, pmi)``.
    ``n_d`` is the record's ``length``, or the sum of its counts where that is null.

    Returns ``term, doc_id, tf, length, df, ttf, p_context, n_records, pmi, ppmi``, one row per
    distinct posting; ``pmi`` is null and ``ppmi`` 0 where tf or length is 0. Records without postings
    count in ``n_records``; repeated record rows count once. Empty tables give no rows.

    Distinct postings are written once below the checkpoint folder and read by column. Group-bys and
    equi-joins only; of the lexicon only hot terms are broadcast, of which there can be 1 / HOT_SHARE
    at most, so no task holds all rows of a term; two totals reach the driver.
    """
    counts = written(distinct_postings(postings))
    lengths = (
        records.where("doc_id is not null").groupBy("doc_id").agg(F.max("length").cast("long").alias("_stated"))
    )
    summed = counts.groupBy("doc_id").agg(F.sum("tf").alias("_sum"))
    sizes = written(
        lengths.withColumn("_listed", F.lit(True)).join(summed.hint("merge"), "doc_id", "full")
        .select("doc_id", F.coalesce("_stated", "_sum").alias("length"), "_sum", F.coalesce("_listed", F.lit(False)).alias("_listed"))
    )
    n_records, context = sizes.agg(
        F.count_if("_listed"), F.sum(F.when(F.col("_sum").isNotNull() & (F.col("length") > 0), F.pow(F.col("length").cast("double"), F.lit(exponent)))),
    ).first()
    terms = written(counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf")))
    hot_from = max(1.0, HOT_SHARE * counts.count())
    hot = terms.where(F.col("df") >= hot_from)
    rare = terms.where(F.col("df") < hot_from)
    by_term = (
        counts.join(F.broadcast(hot), "term")
        .unionByName(counts.join(F.broadcast(hot.select("term")), "term", "left_anti").join(rare.hint("merge"), "term"))
    )
    p_context = F.pow(F.col("length").cast("double"), F.lit(exponent)) / F.lit(context or 1.0)
    scored = by_term.join(sizes.select("doc_id", "length").hint("merge"), "doc_id").withColumn("p_context", p_context)
    pmi = F.when((F.col("length") > 0) & (F.col("tf") > 0), F.log(F.col("tf") / F.col("ttf") / F.col("p_context")))
    return scored.select(
        "term", "doc_id", "tf", "length", "df", "ttf", "p_context", F.lit(n_records).cast("long").alias("n_records"),
        pmi.alias("pmi"), F.greatest(F.lit(0.0), F.coalesce(pmi, F.lit(0.0))).alias("ppmi"),
    )


def marking(scored: DataFrame, least: float = 0.25, least_df: int = 2) -> DataFrame:
    """Terms that mark their record: those whose score reaches what it would be if relative frequency
    times ``ln(1 + N / df)`` were ``least``, in terms held by ``least_df`` records or more; rows at
    the edge are checked by that product itself."""
    rarity = F.log(1 + F.col("n_records") / F.col("df"))
    level = F.log(least * F.col("length") / rarity / F.col("ttf") / F.col("p_context"))
    marked = scored.where((F.col("length") > 0) & (F.col("df") >= least_df) & (F.col("pmi") >= level - 1e-9))
    return marked.where(F.col("tf") / F.col("length") * rarity >= least).select("doc_id", "term")
