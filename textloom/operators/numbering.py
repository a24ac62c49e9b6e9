"""Consecutive numbers for rows in a total order, without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.plans.session import cut


def numbered(df: DataFrame, order: list[str | Column], name: str = "number", first: int = 1) -> DataFrame:
    """``df`` with ``name`` counting from ``first`` in ``order``: rows are range-partitioned and
    sorted, numbered inside their partition, and moved by the rows of the partitions before it
    (one count per partition reaches the driver)."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    before, total = {}, first
    for part in sorted(counts):
        before[part] = total
        total += counts[part]
    spark = df.sparkSession
    moved = spark.createDataFrame([(p, n) for p, n in before.items()], "_part int, _before long")
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        placed.join(F.broadcast(moved), "_part")
        .withColumn(name, F.col("_before") + F.row_number().over(inside) - 1)
        .drop("_part", "_before")
    )


def running_sum(df: DataFrame, key: list[str], order: list[str], value, name: str = "running") -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the same key up to each row in
    ``order``. Rows are range-partitioned by key and order, so a key that holds a large share
    of them spreads over tasks; a row adds its partition's running sum to the key's totals of
    the partitions before (one row per key and partition). Null keys form a key."""
    placed = cut(
        df.withColumn("_value", value)
        .repartitionByRange(*key, *order)
        .sortWithinPartitions(*key, *order)
        .withColumn("_part", F.spark_partition_id())
    )
    totals = placed.groupBy("_part", *key).agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        F.col("_part").alias("_p"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)),
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"),
    )
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    upto = Window.partitionBy("_part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.join(before, same)
        .withColumn(name, F.col("_before") + F.sum("_value").over(upto))
        .drop("_part", "_p", "_before", "_value", *(f"_k{i}" for i in range(len(key))))
    )


def ranked(df: DataFrame, key: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Row numbers from 0 within each key, without a task that sees all rows of a key."""
    return running_sum(df, key, order, F.lit(1), name).withColumn(name, F.col(name) - 1)


def with_previous(df: DataFrame, key: list[str], value: str, name: str = "previous") -> DataFrame:
    """The next smaller value (or equal one of another row) of the same key; null at the first."""
    placed = ranked(df, key, [value], "_at")
    last = placed.select(*(F.col(k).alias(f"_q{i}") for i, k in enumerate(key)), (F.col("_at") + 1).alias("_next"), F.col(value).alias(name))
    same = F.col("_at") == F.col("_next")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_q{i}"))
    return placed.join(last, same, "left").drop("_at", "_next", *(f"_q{i}" for i in range(len(key))))
