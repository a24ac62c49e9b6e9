"""An index as a folder of Parquet tables with its configuration."""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions.analysis import AnalyzerConfig
from textloom.operators.index import Index, corpus_stats, term_stats

VERSION = 1
SUFFIX = ".textloom"


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    target, fs = _file_system(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).collect()  # one small file
    return rows[0][0]


def save(index: Index, path: str) -> str:
    """Write the tables below ``path``: ``docs`` as they lie, ``postings`` and ``terms`` range
    partitioned and sorted by term, so that a term's rows are found by the files' statistics
    while a frequent term may spread over files; ``stats`` and, last of all, the configuration
    file, without which nothing loads. Each save has a folder of its own, named in that file, so
    readers see either the old or the new index; the folder before the latest stays for readers that
    have begun, older ones are removed."""
    spark = index.docs.sparkSession
    before = _runs(spark, path)
    run = uuid.uuid4().hex
    base = f"{path}/{run}"
    index.docs.write.parquet(f"{base}/docs")
    postings = index.postings
    if not index.written:
        # range partitioning reads its input twice, so the texts shouldn't be analysed for each
        postings.write.parquet(f"{base}/_unsorted")
        postings = spark.read.schema(postings.schema).parquet(f"{base}/_unsorted")
    postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{base}/postings")
    _remove(spark, f"{base}/_unsorted")
    terms = term_stats(spark.read.parquet(f"{base}/postings"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{base}/terms")
    corpus_stats(spark.read.parquet(f"{base}/docs"), spark.read.parquet(f"{base}/terms")).write.parquet(f"{base}/stats")
    header = {"version": VERSION, "data": run, "analyzer": index.config.to_dict(), "k1": index.k1, "b": index.b}
    _write_text(spark, f"{path}/index.json", json.dumps(header))
    for old in before:  # the latest of these may still be read, also by the index that was saved
        _remove(spark, f"{path}/{old}")
    return path


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, path: str) -> None:
    target, fs = _file_system(spark, path)
    fs.delete(target, True)


def _runs(spark: SparkSession, path: str) -> list[str]:
    """Folders of saves before the latest."""
    target, fs = _file_system(spark, path)
    if not fs.exists(target):
        return []
    try:
        latest = header(spark, path)["data"]
    except ValueError:
        return []
    names = [s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory()]
    return [n for n in names if n != latest and re.fullmatch("[0-9a-f]{32}", n)]


def header(spark: SparkSession, path: str) -> dict:
    """Configuration and version of an index; ValueError where it is none or of another one."""
    try:
        found = json.loads(_read_text(spark, f"{path}/index.json"))
    except Exception as e:
        raise ValueError(f"{path} holds no index") from e
    if found.get("version") != VERSION:
        raise ValueError(f"{path} has version {found.get('version')}, not {VERSION}")
    return found


def load(spark: SparkSession, path: str) -> Index:
    """The index with the analysis and ranking options that it was made with."""
    h = header(spark, path)
    base = f"{path}/{h['data']}"
    read = lambda name: spark.read.parquet(f"{base}/{name}")
    return Index(read("docs"), read("postings"), AnalyzerConfig.from_dict(h["analyzer"]), h["k1"], h["b"], read("terms"), True, read("stats"))


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """The statistics row alone."""
    return spark.read.parquet(f"{path}/{header(spark, path)['data']}/stats")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """The lexicon alone."""
    return spark.read.parquet(f"{path}/{header(spark, path)['data']}/terms")


def read_term(spark: SparkSession, path: str, term: str) -> DataFrame:
    """Postings of one term; the filter reaches the scan and skips other row groups."""
    return spark.read.parquet(f"{path}/{header(spark, path)['data']}/postings").where(F.col("term") == term)


def find_index(folder: str = ".") -> str | None:
    """The newest index in a local folder, by its configuration file's time."""
    found = []
    for name in os.listdir(folder):
        at = os.path.join(folder, name, "index.json")
        if os.path.isfile(at):
            found.append((os.path.getmtime(at), os.path.join(folder, name)))
    return max(found)[1] if found else None


def compression(index: Index) -> DataFrame:
    """``json_bytes, index_bytes, saved``: stored documents as JSON against varint postings."""
    from textloom.functions.codecs import encoded_postings

    stored = [c for c in index.docs.columns if c != "length"]
    raw = index.docs.agg(F.sum(F.octet_length(F.to_json(F.struct(*stored)))).alias("json_bytes")).withColumn("_one", F.lit(1))
    coded = encoded_postings(index.postings).agg(F.sum(F.col("data_bytes") + F.octet_length("term")).alias("index_bytes"))
    return (
        raw.join(coded.withColumn("_one", F.lit(1)), "_one")
        .select("json_bytes", "index_bytes", F.round(1 - F.col("index_bytes") / F.col("json_bytes"), 6).alias("saved"))
    )
