"""Ranks and running sums in a global order, without one task that sees all rows.

Rows are put in buckets whose keys follow the order. Sums of the buckets become
offsets, level by level; only the rows of one bucket are sorted together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rng import digits
from .stored import stored

#: Rows that one bucket of a hash order holds, about.
BUCKET_ROWS = 20_000


def hash_digits(rows: int, per_bucket: int = BUCKET_ROWS) -> int:
    """Hex digits of a hash that cut `rows` rows into buckets of about per_bucket."""
    return max(1, math.ceil(math.log(max(1.0, rows / per_bucket), 16)))


def _offsets(rows: DataFrame, by: list[str], levels: list[str], values: Sequence[str]) -> DataFrame:
    """(by..., levels..., _base_<value>): the sums of value over the buckets before each, within `by`."""
    sums_of = {v: f"_sum_{v}" for v in values}
    leaf = rows.groupBy(*by, *levels).agg(*[F.sum(v).alias(s) for v, s in sums_of.items()])
    offsets: DataFrame | None = None
    for depth, level in enumerate(levels):
        parents = by + levels[:depth]
        sums = leaf if depth == len(levels) - 1 else leaf.groupBy(*parents, level).agg(*[F.sum(s).alias(s) for s in sums_of.values()])
        w = Window.partitionBy(*parents).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
        here = sums.select(*parents, level, *[F.coalesce(F.sum(s).over(w), F.lit(0)).alias(f"_at{depth}_{v}") for v, s in sums_of.items()])
        offsets = here if offsets is None else here.join(offsets, parents)
    return offsets.select(*by, *levels, *[sum((F.col(f"_at{d}_{v}") for d in range(len(levels))), F.lit(0)).alias(f"_base_{v}") for v in values])


def _added(met: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows that have met their bucket's offsets, with before_<value> in their place."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return met.withColumns({f"before_{v}": F.col(f"_base_{v}") + F.coalesce(F.sum(v).over(w), F.lit(0)) for v in values}).drop(*[f"_base_{v}" for v in values])


def running_sums(rows: DataFrame, by: Sequence[str], levels: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Adds before_<value>: the sum of value over the rows that come earlier in
    the order (levels..., order...) within `by`.

    The columns of by and levels must not be null. Rows is read more than once:
    it must be deterministic, and a stored table if it is costly.
    """
    by, levels = list(by), list(levels)
    return _added(rows.join(_offsets(rows, by, levels, values), by + levels), by + levels, order, values)


def hash_ranked(rows: DataFrame, seed: str | Column, id_col: str, by: Sequence[str] = (), values: Sequence[str] = (), n: int | None = None) -> DataFrame:
    """Adds rank (0-based) in the order of the hash of seed and id, and before_<value> sums, within by."""
    return hash_ranked_in_slices(rows, seed, id_col, by, values, n, 1)[0]


def hash_ranked_in_slices(rows: DataFrame, seed: str | Column, id_col: str, by: Sequence[str], values: Sequence[str], n: int | None, slices: int) -> list[DataFrame]:
    """The rows of hash_ranked in so many tables, by their hash: each shuffles its own rows only. The hash itself is not shuffled."""
    n, h, keys, values = rows.count() if n is None else n, digits(seed, F.col(id_col)), [*by, "_part"], ["rank", *values]
    own = rows.withColumn("_part", F.substring(h, 1, hash_digits(n))).withColumn("rank", F.lit(1).cast("long"))
    base = _offsets(own, list(by), ["_part"], values)
    if slices > 1:
        base = stored(base, "offsets")
    slice_of = F.pmod(F.xxhash64("_part"), F.lit(slices))
    ranked = [_added((own if slices == 1 else own.filter(slice_of == k)).join(base, keys).withColumn("_h", h), keys, ["_h", id_col], values) for k in range(slices)]
    return [t.drop("rank").withColumnRenamed("before_rank", "rank").drop("_h", "_part") for t in ranked]


def value_ranked(rows: DataFrame, key: str, seed: str, id_col: str, by: Sequence[str] = (), values: Sequence[str] = ()) -> DataFrame:
    """As hash_ranked, in the order of a key, then of the hash, then of the id.

    Ranges of (key, hash, id), as many as the rows fill with BUCKET_ROWS each,
    are the level above the rows: Spark cuts them from a sample of all rows, so
    neither the number of rows nor a key that many of them share makes a range large.
    """
    own = rows.withColumn("_h", digits(seed, F.col(id_col)))
    ranges = max(1, math.ceil(rows.count() / BUCKET_ROWS))
    dealt = own.repartitionByRange(ranges, key, "_h", id_col).withColumns({"_range": F.spark_partition_id(), "rank": F.lit(1).cast("long")})
    out = running_sums(stored(dealt, "ranges"), by, ["_range"], [key, "_h", id_col], ["rank", *values])
    return out.drop("rank").withColumnRenamed("before_rank", "rank").drop("_h", "_range")


def counted_before(rows: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """(by..., key, n, before_n): of every distinct key, the rows that hold it and the rows of lesser keys, within by."""
    counts = stored(rows.groupBy(*by, key).agg(F.count("*").alias("n")), "key-counts")
    return value_ranked(counts, key, "key", key, by=by, values=["n"]).drop("rank")


def exact_percentiles(rows: DataFrame, key: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., q): the interpolated percentiles of a number within by, as an array; nulls do not count.

    Found by rank: no task holds the distinct values of a group.
    """
    by = list(by)
    own = stored(counted_before(rows.filter(F.col(key).isNotNull()), key, by), "key-ranks")
    last = own.groupBy(*by).agg((F.sum("n") - 1).alias("_last"))
    met = own.join(last, by) if by else own.join(F.broadcast(last))
    at = lambda place: F.max(F.when((F.col("before_n") <= place) & (place < F.col("before_n") + F.col("n")), F.col(key).cast("double")))
    out = []
    for i, s in enumerate(shares):
        place = F.col("_last") * F.lit(float(s))
        out += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}")]
    ends = met.groupBy(*by, "_last").agg(*out)
    q = []
    for i, s in enumerate(shares):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        place = F.col("_last") * F.lit(float(s))
        q.append(lo + (place - F.floor(place)) * (hi - lo))
    return ends.select(*by, F.array(*q).alias("q"))
