"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that drops an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: list[str] = []
_tables: list[str] = []  # stored tables, in order


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one of our own in local mode and an error on a cluster."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-shared-"))
    return _own[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path there that nothing uses; it goes when the driver's JVM ends, if not before."""
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table there: cuts the plan, and survives lost executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the table replaces the shuffle files of the job that makes it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    _tables.append(path)
    return out


def stored_so_far() -> int:
    return len(_tables)


def erase_since(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Deletes the tables stored since the mark that no later plan reads, but for those to keep: for the steps of a loop."""
    kept = {t._stored_at for t in keep}
    for path in _tables[mark:]:
        if path not in kept:
            _delete(spark, path)
    _tables[mark:] = [p for p in _tables[mark:] if p in kept]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def erase(*tables: DataFrame) -> None:
    """Deletes stored tables that no later plan reads: those that a loop has replaced."""
    for t in tables:
        _delete(t.sparkSession, t._stored_at)
