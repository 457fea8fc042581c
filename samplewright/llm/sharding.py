"""Sharding along a Hilbert curve over quantised metadata.

Each dimension is cut at its quantiles over all rows; the cells are numbered
along a Hilbert curve; the rows, in that order, are cut into runs of near equal
bytes. Rows of a shard are then close in every dimension at once, so that the
least and greatest values of a shard or file prune on each of them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..prefix import BUCKET_ROWS
from .common import HOT_SHARE, hash_digits, running_sums, written

#: Bits for each dimension; three dimensions have 4096 cells.
BITS = 4
N_SHARDS = 8


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Place of a cell on the Hilbert curve (transposed form of Skilling, 2004).

    axes: integers below 2 ** bits. The state of every step is one array, so the
    expression stays small whatever the number of bits.
    """
    n = len(axes)
    at = F.array(*[a.cast("long") for a in axes])
    inverse = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def undo(x: Column, step: Column) -> Column:
        p = step["q"] - 1
        own = F.get(x, step["i"])
        swap = F.get(x, F.lit(0)).bitwiseXOR(own).bitwiseAND(p)
        set_ = own.bitwiseAND(step["q"]) != 0

        def new(v: Column, j: Column) -> Column:
            flipped = F.when(j == 0, v.bitwiseXOR(p)).otherwise(v)
            swapped = F.when((j == 0) | (j == step["i"]), v.bitwiseXOR(swap)).otherwise(v)
            return F.when(set_, flipped).when(step["i"] == 0, v).otherwise(swapped)

        return F.transform(x, new)

    at = F.aggregate(inverse, at, undo)

    def gray(x: Column) -> Column:
        # element j becomes the XOR of elements 0..j
        return F.transform(x, lambda v, j: F.aggregate(F.slice(x, 1, j + 1), F.lit(0).cast("long"), lambda s, y: s.bitwiseXOR(y)))

    def tail(x: Column) -> Column:
        last = F.get(x, F.lit(n - 1))
        t = F.aggregate(
            F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]),
            F.lit(0).cast("long"),
            lambda s, q: F.when(last.bitwiseAND(q) != 0, s.bitwiseXOR(q - 1)).otherwise(s),
        )
        return F.transform(x, lambda v: v.bitwiseXOR(t))

    # lambdas over a one-element array bind each intermediate state once
    state = F.transform(F.transform(F.array(at), gray), tail)
    places = [(F.lit(1 << (b * n + n - 1 - i)).cast("long"), F.lit(1 << b).cast("long"), i) for b in range(bits) for i in range(n)]
    index = F.transform(state, lambda x: sum((F.when(F.get(x, F.lit(i)).bitwiseAND(bit) != 0, place).otherwise(F.lit(0).cast("long")) for place, bit, i in places), F.lit(0).cast("long")))
    return F.get(index, F.lit(0))


def _text_cell(df: DataFrame, value: Column, cells: int) -> Column:
    """Equi-depth cell of a string, from the counts of all its values in order; whole strings are compared."""
    counts = df.select(value.alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    counts = written(counts, "values")
    ranges = counts.repartitionByRange(max(1, counts.count() // BUCKET_ROWS), "v").withColumn("part", F.spark_partition_id())
    before = running_sums(written(ranges, "value-ranges"), [], ["part"], ["v"], ["n"])
    total = counts.agg(F.sum("n")).first()[0] or 1
    cell = F.floor(F.col("before_n") * F.lit(cells) / F.lit(total)).cast("int")
    cuts = before.groupBy(cell.alias("cell")).agg(F.min("v").alias("v")).orderBy("cell").collect()  # a row for each cell
    found = F.lit(0)
    for r in cuts:  # the last cut that is not above the value
        found = F.when(value >= F.lit(r["v"]), r["cell"]).otherwise(found)
    return F.coalesce(F.when(value.isNotNull(), found), F.lit(0))


def _cells(df: DataFrame, dims: Mapping[str, Column], bits: int) -> list[Column]:
    """Equi-depth code of each dimension, from quantiles over all rows; null is the lowest cell."""
    n, kinds = 1 << bits, dict(df.select(*[c.alias(k) for k, c in dims.items()]).dtypes)
    numbers = {k: c.cast("double") for k, c in dims.items() if kinds[k] != "string"}
    cuts = df.agg(*[F.percentile_approx(c, [i / n for i in range(1, n)], 10_000).alias(k) for k, c in numbers.items()]).first() if numbers else {}
    out = []
    for k, c in dims.items():
        if k not in numbers:
            out.append(_text_cell(df, c, n))
            continue
        bounds = F.array(*[F.lit(float(x)) for x in cuts[k] or []]).cast("array<double>")
        out.append(_below(bounds, numbers[k]))
    return out


def _below(bounds: Column, value: Column) -> Column:
    """How many of the bounds are below a value; 0 for null."""
    return F.when(value.isNotNull(), F.size(F.filter(bounds, lambda b: b < value))).otherwise(F.lit(0))


def hilbert_shards(
    df: DataFrame, dims: Mapping[str, Column], size: Column, tie: Column, id_col: str = "doc_id", n_shards: int = N_SHARDS, bits: int = BITS, extra: Mapping[str, Column] | None = None
) -> DataFrame:
    """Deals rows to n_shards runs of the Hilbert curve with near equal sums of size.

    Returns (id, size, hilbert, shard, slot) and the extra columns, one row per
    input row. A row goes to the shard in which the middle of its stretch of the
    running sum falls, so a shard differs from an equal part by less than one row.
    Rows of one cell are ordered by a hash of tie, then id: rows with equal ties are
    neighbours. A tie that many rows share is a bucket of its own, cut further
    by a hash of the id. Null dimensions are the lowest cell; size must be positive. Empty
    tables give no rows. dims, size and tie are evaluated on df, whose other
    columns are not read.
    """
    extra = dict(extra or {})
    cells = _cells(df, dims, bits)
    rows = df.select(F.col(id_col).alias("id"), size.alias("size"), hilbert_index(cells, bits).alias("hilbert"), F.md5(tie.cast("string")).alias("tie"), *[c.alias(k) for k, c in extra.items()])
    rows = written(rows, "curve")
    known = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    total, digits = known["bytes"] or 1, hash_digits(known["n"] or 1)
    many = max(BUCKET_ROWS, math.ceil((known["n"] or 0) * HOT_SHARE))  # at most 1 / HOT_SHARE ties are as frequent
    hot = rows.groupBy("tie").agg(F.count("*").alias("n")).filter(F.col("n") > many).select("tie", F.lit(True).alias("hot"))
    part = F.when(F.col("hot"), F.col("tie")).otherwise(F.substring("tie", 1, digits))
    split = F.when(F.col("hot"), F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, digits)).otherwise("")
    leaf = written(rows.join(F.broadcast(hot), "tie", "left").withColumns({"part": part, "split": split, "one": F.lit(1).cast("long")}).drop("hot"), "leaves")
    placed = running_sums(leaf, [], ["hilbert", "part", "split"], ["tie", "id"], ["size", "one"])
    middle = 2 * F.col("before_size") + F.col("size")
    shard = F.least(F.floor(middle.cast("decimal(38,0)") * n_shards / F.lit(2 * total).cast("decimal(38,0)")), F.lit(n_shards - 1)).cast("int")
    placed = written(placed.withColumn("shard", shard).select("id", "size", "hilbert", *extra, "shard", "before_one"), "placed")
    starts = placed.groupBy("shard").agg(F.min("before_one").alias("start"))  # a row for each shard
    return placed.join(F.broadcast(starts), "shard").select("id", "size", "hilbert", *extra, "shard", (F.col("before_one") - F.col("start")).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """documents by source, language and length: (id, size, hilbert, text_crc32, shard, slot)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    dims = {"source": F.col("source"), "lang": F.col("lang"), "size": size}
    return hilbert_shards(docs, dims, size, F.xxhash64(text), n_shards=n_shards, extra={"text_crc32": F.crc32(F.encode(text, "UTF-8"))})


def write_shards(df: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", files_per_shard: int = 1, n_shards: int = N_SHARDS) -> None:
    """Writes df in shard and slot order, a folder a shard; raises where an id has several places, as it could not be told which row is meant."""
    at = placed.select(F.col("id").alias(id_col), "shard", "slot")
    if not at.groupBy(id_col).count().filter("count > 1").isEmpty():
        raise ValueError(f"{id_col} is not unique")
    out = df.drop("shard", "slot").join(at, id_col).repartitionByRange(files_per_shard * n_shards, "shard", "slot")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_ranges(df: DataFrame, placed: DataFrame, dims: Mapping[str, Column], id_col: str = "doc_id") -> DataFrame:
    """Least and greatest value of each dimension in each shard, for pruning."""
    at = placed.select(F.col("id").alias(id_col), "shard")
    own = df.select(id_col, *[c.alias(k) for k, c in dims.items()])
    return own.join(at, id_col).groupBy("shard").agg(*[f(k).alias(f"{n}_{k}") for k in dims for n, f in (("min", F.min), ("max", F.max))])
