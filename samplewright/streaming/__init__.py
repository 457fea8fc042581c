"""Incremental forms of the results mart, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.results import collect_runs, long_metrics


def stream_run_logs(spark: SparkSession, path: str, name: str = "stdout.log") -> DataFrame:
    """(path, text) of logs as they appear below a folder."""
    raw = spark.readStream.schema("value string").options(recursiveFileLookup=True, pathGlobFilter=name, wholetext=True).format("text").load(path)
    return raw.selectExpr("_metadata.file_path AS path", "value AS text")


def append_metrics(logs: DataFrame, datasets: Sequence[str], out: str, checkpoint: str) -> StreamingQuery:
    """Appends the long metrics of new logs to a Parquet table; finishes with what is there."""
    own = long_metrics(collect_runs(logs, datasets))
    return own.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)
