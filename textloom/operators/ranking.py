"""Relevance as Column expressions, and the best rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def bm25_idf(df: Column, n: Column) -> Column:
    """``ln((n - df + 0.5) / (df + 0.5) + 1)``; 0 where either isn't positive."""
    return F.when((n > 0) & (df > 0), F.log((n - df + 0.5) / (df + 0.5) + 1)).otherwise(F.lit(0.0))


def bm25(tf: Column, length: Column, average: Column, idf: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    norm = F.when(average > 0, 1 - b + b * length / average).otherwise(F.lit(1.0))
    return F.when(tf > 0, idf * (tf * (k1 + 1)) / (tf + k1 * norm)).otherwise(F.lit(0.0))


def tfidf_idf(df: Column, n: Column) -> Column:
    """``ln(1 + n / df)``; 0 where either isn't positive."""
    return F.when((n > 0) & (df > 0), F.log(1 + n / df)).otherwise(F.lit(0.0))


def tfidf(tf: Column, length: Column, idf: Column) -> Column:
    return F.when((length > 0) & (tf > 0), tf / length * idf).otherwise(F.lit(0.0))


def top(df: DataFrame, limit: int, *, score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The best ``limit`` rows (at least one), ties by id; keeps that many per partition."""
    return df.orderBy(F.col(score).desc(), tie).limit(max(1, limit))


def top_each(df: DataFrame, key: str, limit: int, *, score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The best rows of each key with their ``rank``. A rank filter above the window lets the
    engine keep only ``limit`` rows per key and partition before the shuffle."""
    best = Window.partitionBy(key).orderBy(F.col(score).desc(), tie)
    return df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(1, limit))
