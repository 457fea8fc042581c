"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import math
import os
import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..prefix import hash_digits, running_sums

__all__ = ["attach", "components", "erase", "erase_path", "erase_since", "hash_digits", "kept_once", "read", "running_sums", "shared_dir", "shared_path", "squeezed", "unused", "word_count", "written", "written_so_far"]

#: White space as the contracts define it: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: A class of rows is hot from this share of the rows on; there can be at most
#: 1 / HOT_SHARE such classes, so a table of hot classes may be broadcast.
HOT_SHARE = 1 / 1000

#: Spark's setting that drops an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: list[str] = []
_written: list[str] = []  # folders of written tables, in order


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where the setting is absent: a folder of our own in local mode (tests), an
    error on a cluster, whose machines would each write to their own disk.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-shared-"))
    return _own_dir[0]


def shared_path(spark: SparkSession, name: str) -> str:
    """A path there that nothing uses, for files of other formats; it goes with erase_path, or else when the driver's JVM ends."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def erase_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors.

    The files go with erase or erase_since, or else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the table replaces the shuffle files of the job that makes it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _written.append(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def written_so_far() -> int:
    return len(_written)


def erase_since(mark: int, keep: DataFrame) -> None:
    """Deletes the tables written since the mark, but for keep, the last one written: for a step whose result it is."""
    spark = keep.sparkSession
    kept = {os.path.basename(os.path.dirname(f)) for f in keep.inputFiles()} | {os.path.basename(p) for p in _written[-1:]}
    for path in _written[mark:]:
        if os.path.basename(path) not in kept:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written[mark:] = [p for p in _written[mark:] if os.path.basename(p) in kept]


def erase(table: DataFrame) -> None:
    """Deletes a written table that no later plan reads, and lets the driver's
    cleaner drop the shuffle files of plans that are gone."""
    spark = table.sparkSession
    folders = {os.path.dirname(f) for f in table.inputFiles()}
    for folder in folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    spark._jvm.System.gc()


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name += "_"
    return name


def kept_once(docs: DataFrame, keys: list[Column], kept: DataFrame) -> DataFrame:
    """The rows of docs whose keys are in kept, with all their columns: one for each row of kept keys.

    kept: the same keys, null-safe, by place. Rows that repeat a key are rows with
    one text; the one with the least hash of all its columns stays.
    """
    names = [unused(docs, f"_key{j}") for j in range(len(keys))]
    counted = written(kept.toDF(*names).groupBy(*names).agg(F.count("*").alias(unused(docs, "_times"))), "kept")
    times = counted.columns[-1]
    on = reduce(lambda x, y: x & y, [k.eqNullSafe(counted[n]) for k, n in zip(keys, names, strict=True)])
    out = docs.join(counted.filter(F.col(times) == 1), on, "left_semi")
    repeated = counted.filter(F.col(times) > 1)
    if repeated.isEmpty():
        return out
    row = F.struct(*[docs[c] for c in docs.columns])
    again = docs.join(repeated, on).select(*names, row.alias("row"), F.xxhash64(row).alias("h"))
    return out.unionByName(again.groupBy(*names).agg(F.min_by("row", "h").alias("row")).select("row.*"))


def squeezed(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space; 0 for null.

    A run starts at each non-space that follows a space or the start: both are
    counted by lengths, without an array of words.
    """
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "\u0001")
    return F.length(F.translate(spaced, SPACE, "")).cast("long")


def attach(rows: DataFrame, classes: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """rows left-joined to one row per class, without a hot partition.

    Classes that hold HOT_SHARE of the rows or more are at most 1 / HOT_SHARE
    and are broadcast; the others meet in a sort-merge join, however few they seem:
    a table of them grows with the rows, and the driver would build it whole.
    """
    floor = max(1, math.ceil(total * HOT_SHARE))
    gained = [c for c in classes.columns if c not in ([key] if isinstance(key, str) else key)]
    hot, cold = classes.filter(F.col(size) >= floor), classes.filter(F.col(size) < floor)
    hit = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    return (
        hit.filter("_hot").drop("_hot").unionByName(hit.filter("_hot is null").drop("_hot", *gained).join(cold.hint("merge"), key, "left"))
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the edges (a long, b long): (node, component), the
    component being its smallest node. Nodes without edges do not appear.

    Alternates the two star contractions of Kiveris et al. (2014): every round
    is two grouped minima with map-side combining, no neighbour list is ever
    gathered, and the number of edges does not grow. Each round is written.
    """
    now, before = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"), None
    for _ in range(max_rounds):
        # large star: a node's larger neighbours go to the least of it and its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the least of these
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
