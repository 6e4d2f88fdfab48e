"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "dyadspark", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local run may do without: there a temporary one is set. On several machines a missing setting is an error,
    since each executor would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="dyadspark-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for tables written between jobs."""
    return f"{shared_dir(spark)}/dyadspark/{name}-{uuid.uuid4().hex}"


_passing: list[list[str]] = []


@contextmanager
def passing() -> Iterator[list[str]]:
    """Tables stored inside are removed at the end, but for those whose path is taken out of the list."""
    _passing.append([])
    try:
        yield _passing[-1]
    finally:
        spark = SparkSession.getActiveSession()
        for name in _passing.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session that hold for the jobs inside; ``_`` stands for a dot."""
    before = {k: spark.conf.get(k, None) for k in (name.replace("_", ".") for name in values)}
    try:
        for k, v in zip(before, values.values()):
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffles_dropped(spark: SparkSession):
    """What the jobs inside shuffle is removed from the executors' disks with their end, not whenever the driver collects garbage."""
    return settings(spark, spark_sql_classic_shuffleDependency_fileCleanup_enabled="true")


def narrow_rows(spark: SparkSession):
    """For jobs that send only rows of a few numbers to Python: large batches, whose bytes are not counted row by row."""
    return settings(spark, spark_sql_execution_arrow_maxBytesPerBatch=str((1 << 31) - 1), spark_sql_execution_arrow_maxRecordsPerBatch="65536")


def stored(df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read back.

    Used to cut lineage between steps, to fix positions before they are used, and for summaries: Spark then knows the
    true size, so its own threshold decides whether a join may broadcast the table, and the large side of that join is
    not shuffled just because the size could not be told beforehand. The data survive the loss of any executor.
    """
    path = scratch_path(df.sparkSession, "table")
    if _passing:
        _passing[-1].append(path)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
