"""Sessions, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, name: str = "textloom") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", os.environ.get("TEXTLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables up to this size are spread over all cores if they lie in fewer files.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out to all cores if it is a small scan of fewer files than cores, as its few
    splits would else do all the work. Larger inputs have splits enough and aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= SPREAD_BYTES and len(df.inputFiles()) < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share. Only where none is
    configured (single-machine tests) a temporary one is used."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
        if not shared:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="textloom-checkpoint-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that later jobs neither recompute it nor
    depend on one executor's disk. Spark removes the files with the plan that reads them where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of each job are removed when it ends, not when the driver
    happens to collect its garbage. For steps that are ``written`` one after the other."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


_WRITTEN: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession) -> str:
    """A new path below the shared folder, removed by ``release``."""
    path = f"{shared_folder(spark)}/textloom-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table below the shared folder and read again: for tables that
    several jobs read, each other columns of. The tables stay until ``release`` or the end of
    the session's process."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def release() -> None:
    """Remove the tables of ``written`` and ``scratch``; DataFrames that read them can't be used any more."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            sc = spark.sparkContext
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended before
            shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)
