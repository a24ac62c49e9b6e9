"""The document log: append, replay, checkpoint, and incremental indexing from a stream."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions.analysis import AnalyzerConfig
from textloom.operators.index import Index, build_index, term_stats
from textloom.plans.session import cut
from textloom.sources.storage import save

SCHEMA = "sequenceNumber long, timestamp long, type string, payload struct<id: long, title: string, body: string, text: string>"


def append(docs: DataFrame, folder: str, first: int = 1) -> None:
    """Write documents as INSERT lines to the log folder; before they are indexed."""
    has = docs.columns
    col = lambda n: F.col(n) if n in has else F.lit(None).cast("string")
    payload = F.struct(F.col("doc_id").alias("id"), *(col(n).alias(n) for n in ("title", "body", "text")))
    line = F.struct(
        (F.monotonically_increasing_id() + first).alias("sequenceNumber"), F.lit(int(time.time() * 1000)).alias("timestamp"),
        F.lit("INSERT").alias("type"), payload.alias("payload"),
    )
    docs.select(F.to_json(line).alias("value")).write.mode("append").text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the log with their place (file time, file, place in it); lines that are no JSON are skipped."""
    raw = spark.read.text(folder).select(
        "value", F.struct(
            F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"),
        ).alias("place"),
    )
    parsed = F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"})
    return raw.select(parsed.alias("x"), "place").where("x.type is not null").select("x.*", "place")


def replay(entries: DataFrame, indexed: DataFrame | None = None, order: str = "place") -> DataFrame:
    """Documents that the log holds and the index lacks: of each id the first INSERT in
    ``order``. Sequence numbers may start again, so they don't tell the order. Lines without a
    payload or id are skipped; ids in ``indexed`` (doc_id) too. Grouped by id with partial
    aggregation, so an id that repeats without end stays one row per partition."""
    valid = entries.where("type = 'INSERT' and payload is not null and payload.id is not null")
    first = valid.groupBy(F.col("payload.id").alias("doc_id")).agg(F.min_by("payload", order).alias("p"))
    docs = first.select("doc_id", *(F.col(f"p.{n}") for n in first.schema["p"].dataType.names if n != "id"))
    return docs if indexed is None else docs.join(indexed.select("doc_id"), "doc_id", "left_anti")


def last_sequence(entries: DataFrame) -> int:
    return entries.agg(F.max("sequenceNumber")).first()[0] or 0


def checkpoint(spark: SparkSession, folder: str) -> None:
    """Empty the log once its documents are in the index."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(path, True)
    fs.mkdirs(path)


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _ingest(spark: SparkSession, batch: DataFrame, number: int, target: str, config: AnalyzerConfig) -> None:
    """Write the batch's new documents as one folder each of ``postings``, ``terms`` and ``docs``,
    named by the batch. A batch that comes again after a failure writes the same folders over
    again; the folder of its documents comes last and makes it count."""
    held = None
    if _exists(spark, f"{target}/docs"):
        held = spark.read.parquet(f"{target}/docs").where(F.col("batch") != number).select("doc_id")
    fresh = cut(replay(batch.withColumn("place", F.monotonically_increasing_id()), held))
    index = build_index(fresh, config, check=False)
    for name, rows in (("postings", index.postings), ("terms", None), ("docs", index.docs)):
        rows = term_stats(spark.read.parquet(f"{target}/postings/batch={number}")) if rows is None else rows
        rows.write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")


def ingest_stream(spark: SparkSession, folder: str, target: str, checkpoint_folder: str, config: AnalyzerConfig | None = None):
    """Start a stream that indexes the log folder's new lines; a document is found as soon as
    its batch is written. Counts and averages are worked out at query time and the frequencies
    of each batch are only added up, as each new document moves them for all."""
    config = config or AnalyzerConfig()
    lines = spark.readStream.schema(SCHEMA).json(folder)
    return (
        lines.writeStream.option("checkpointLocation", checkpoint_folder)
        .foreachBatch(lambda batch, number: _ingest(batch.sparkSession, batch, number, target, config))
        .trigger(availableNow=True)
        .start()
    )


def live_index(spark: SparkSession, target: str, config: AnalyzerConfig | None = None) -> Index:
    """The index as far as the stream has come. Batches whose documents weren't written (one that
    failed half-way) don't count; they are told by their folders, so postings are neither joined
    nor shuffled. Each batch is a segment; ``compact`` makes one of all."""
    docs = spark.read.parquet(f"{target}/docs")
    batches = [r[0] for r in docs.select("batch").distinct().collect()]  # folders, not documents
    part = lambda name: spark.read.parquet(f"{target}/{name}").where(F.col("batch").isin(batches)).drop("batch")
    terms = part("terms").groupBy("term").agg(F.sum("df").alias("df"), F.sum("ttf").alias("ttf"))
    return Index(docs.drop("batch"), part("postings"), config or AnalyzerConfig(), lexicon=terms, written=True)


def compact(spark: SparkSession, target: str, path: str, config: AnalyzerConfig | None = None) -> str:
    """Save what the stream has written so far as one index below ``path``."""
    return save(live_index(spark, target, config), path)


def watch(spark: SparkSession, folder: str, checkpoint_folder: str, rebuild, seconds: float | None = None):
    """Call ``rebuild()`` after changes below a folder, at most once per trigger, which settles
    bursts. Like a full re-index on any change; deletions show at the next one."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option(
        "recursiveFileLookup", True
    ).load(folder).select("path")
    trigger = {"processingTime": f"{seconds} seconds"} if seconds else {"availableNow": True}
    return (
        files.writeStream.option("checkpointLocation", checkpoint_folder)
        .foreachBatch(lambda batch, _: rebuild() if batch.limit(1).count() else None)
        .trigger(**trigger)
        .start()
    )
