"""Readers and writers of the library's tables and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_labels(spark: SparkSession, path: str, columns: Sequence[str], id_col: str = "ID") -> DataFrame:
    """Label CSV by id: empty and NA are null; only the asked columns, id as id."""
    header = spark.read.option("header", True).csv(path).columns
    absent = [c for c in columns if c not in header]
    if absent:
        raise ValueError(f"no such column: {', '.join(absent)}")
    schema = ", ".join(f"`{c}` {'string' if c == id_col else 'double' if c in columns or c in ('lat', 'lon') else 'string'}" for c in header)
    raw = spark.read.schema(schema).options(header=True, nullValue="NA", emptyValue="").csv(path)
    place = [c for c in ("lat", "lon") if c in header and c not in columns]
    return raw.select(F.col(id_col).alias("id"), *columns, *place)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, x array<float>, lat double, lon double").parquet(path)


def read_wide_features(df: DataFrame, prefix: str, n: int, id_col: str) -> DataFrame:
    """Columns prefix0 .. prefix<n-1> as one vector."""
    return df.select(F.col(id_col).cast("string").alias("id"), F.array(*[F.col(f"{prefix}{i}").cast("double") for i in range(n)]).alias("x"))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(id) of a file with one id a line."""
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''")


def read_assignment(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(id, value), both strings."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return reader.format(fmt).load(path).select(F.col("id").cast("string").alias("id"), F.col("value").cast("string").alias("value"))


def read_sample(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    own = spark.read.schema(schemas.SAMPLE).parquet(path)
    return own.filter(F.col("run_id") == run_id) if run_id else own


def read_run_logs(spark: SparkSession, path: str, name: str = "stdout.log") -> DataFrame:
    """(path, text) of every log below a folder, whole."""
    raw = spark.read.options(recursiveFileLookup=True, pathGlobFilter=name).text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_metric_json(spark: SparkSession, path: str, seeds: Sequence[str] | None = None) -> DataFrame:
    """(path, seed, metric, value) of initial_set_metrics_seed_<seed>.json files; bad files give no rows."""
    raw = spark.read.schema(schemas.METRIC_JSON).options(recursiveFileLookup=True, pathGlobFilter="initial_set_metrics_seed_*.json", multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").json(path)
    seed = F.regexp_extract("_metadata.file_name", r"_seed_(\d+)\.json$", 1)
    own = raw.select(F.col("_metadata.file_path").alias("path"), seed.alias("seed"), "r2", "mse", "rmse", "mae", "_corrupt").filter("_corrupt is null")
    own = own.filter(F.col("seed").isin(list(seeds))) if seeds else own
    long = own.unpivot(["path", "seed"], ["r2", "mse", "rmse", "mae"], "metric", "value")
    return long.filter("value is not null")


def write_table(df: DataFrame, path: str, partitions: Sequence[str] = ("run_id",), mode: str = "overwrite") -> None:
    """Assignments, samples, probabilities and selection metadata: Parquet by run."""
    df.write.mode(mode).partitionBy(*partitions).parquet(path)


def _replace(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Writes the partitions that df has anew and leaves the others: a write that is repeated changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def write_status(df: DataFrame, path: str, run_id: str, episode: int) -> None:
    """The status of all ids before (episode 0) or after (episode 1) a selection, in place of what the run and episode had."""
    _replace(df.select("id", "status").withColumns({"run_id": F.lit(run_id), "episode": F.lit(episode)}), path, ("run_id", "episode"))


def done_runs(spark: SparkSession, path: str, episode: int = 1) -> DataFrame:
    """(run_id) of the runs whose episode a status table holds, from the names of its partitions: for skip_done_runs."""
    return spark.read.parquet(path).filter(F.col("episode") == episode).select(F.col("run_id").cast("string").alias("run_id")).distinct()


def append_scores(df: DataFrame, path: str) -> None:
    """Appends CSV files; each has its own header, as Spark's reader of many files takes it."""
    df.write.mode("append").option("header", True).csv(path)


def read_scores(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All appended scores, every file's header left out."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_results(df: DataFrame, path: str, csv: bool = False) -> None:
    """The mart by dataset, initial set and cost type, in place of what these had; as one CSV a folder for people (the whole mart then)."""
    keys = ("dataset", "init_set", "cost_type")
    if csv:
        df.coalesce(1).write.mode("overwrite").partitionBy(*keys).option("header", True).csv(path)  # the mart has a row for each run key
    else:
        _replace(df, path, keys)


def combined_results(spark: SparkSession, path: str) -> DataFrame:
    """All parts of a mart as one table: the columns of all of them, null where a part has none."""
    return spark.read.option("mergeSchema", True).parquet(path)
