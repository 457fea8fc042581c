"""Aggregations over divisions, tiles, groups and predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..prefix import exact_percentiles
from ..stored import stored
from .prep import average_rank

# Land-cover class codes.
CLASSES = [11, 12, 21, 22, 23, 24, 31, 41, 42, 43, 52, 71, 81, 82, 90, 95]
#: Parts in which the errors of many rows are added up.
SUMS = 256


def counts_per_division(points: DataFrame, division: str) -> DataFrame:
    """Mean, median, least and greatest number of points of a division."""
    n = points.groupBy(division).agg(F.count("*").alias("n"))
    return n.agg(F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.min("n").alias("min"), F.max("n").alias("max"))


def division_histogram(points: DataFrame, division: str, bins: int = 100) -> DataFrame:
    """(bin, divisions): equal bins between the least and the greatest count; the last holds its upper edge."""
    n = points.groupBy(division).agg(F.count("*").alias("n"))
    ends = n.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("n") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    return n.join(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count("*").alias("divisions"))


def nesting_violations(points: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, parents): child divisions with more than one parent."""
    return points.groupBy(F.col(child).alias("child")).agg(F.count_distinct(parent).alias("parents")).filter("parents > 1")


def class_shares(pixels: DataFrame, classes: list[int] = CLASSES, tile: str = "tile_id", keep_empty: bool = False) -> DataFrame:
    """One column c<class> per expected class: its share of the tile's pixels of expected classes.

    A tile without any is dropped; with keep_empty its shares are 0.
    """
    n = lambda c: F.coalesce(F.col(str(c)), F.lit(0))
    counts = pixels.groupBy(tile).pivot("class", classes).count()
    total = sum((n(c) for c in classes), F.lit(0))
    out = counts.withColumn("_t", total).select(tile, "_t", *[F.when(F.col("_t") > 0, n(c) / F.col("_t")).otherwise(0.0).cast("float").alias(f"c{c}") for c in classes])
    return (out if keep_empty else out.filter("_t > 0")).drop("_t")


def group_population_shares(points: DataFrame, ignored: list[str] | None = None) -> DataFrame:
    """(grp, n, share) over the groups that are not ignored."""
    own = points.filter(~F.col("grp").isin(ignored)) if ignored else points
    n = own.groupBy("grp").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_t"))
    return n.join(F.broadcast(total)).select("grp", "n", (F.col("n") / F.col("_t")).alias("share"))


def mean_similarity_per_unit(similarity: DataFrame, unit_of: DataFrame) -> DataFrame:
    """(unit, sim): mean over targets of the mean similarity of the unit's rows; similarity: (row_id, col_id, sim), unit_of: (row_id, unit)."""
    per = similarity.join(unit_of, "row_id").groupBy("unit", "col_id").agg(F.avg("sim").alias("sim"))
    return per.groupBy("unit").agg(F.avg("sim").alias("sim"))


def mean_cosine_per_unit(features: DataFrame) -> DataFrame:
    """(unit, sim): as mean_similarity_per_unit for the cosine of all pairs of a unit's vectors, from (unit, x).

    The mean over all pairs is the squared length of the mean unit vector, so no
    pair is formed; zero vectors are left out.
    """
    x = F.transform("x", lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(F.col("x"), F.lit(0.0), lambda s, v: s + v * v))
    own = features.select("unit", x.alias("x")).withColumn("norm", norm).filter("norm > 0")
    sums = own.select("unit", F.posexplode(F.transform("x", lambda v: v / F.col("norm"))).alias("at", "v")).groupBy("unit", "at").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    return sums.groupBy("unit").agg((F.sum(F.col("v") * F.col("v")) / F.max("n") / F.max("n")).alias("sim"))


def metric_columns(y: Column, p: Column) -> list[Column]:
    """r2, mse, rmse and mae as aggregates; r2 is null when y does not vary."""
    n, e = F.count("*"), y - p
    sse = F.sum(e * e)
    sst = F.var_pop(y) * n
    return [(1 - sse / F.when(sst > 0, sst)).alias("r2"), (sse / n).alias("mse"), F.sqrt(sse / n).alias("rmse"), F.avg(F.abs(e)).alias("mae")]


def precise_metrics(predictions: DataFrame, by: list[str], y: str = "y", p: str = "pred") -> DataFrame:
    """metric_columns by groups, to about the last digit of a double, so that scores of millions of rows can be told apart;
    and unexplained, 1 - r2, which has more digits.

    Rows are added up in SUMS parts by their y first, so no long sum gathers rounding,
    and y's own sum of squares is the same for all predictions of a group of rows.
    """
    e = F.col(y) - F.col(p)
    parts = predictions.groupBy(*by, F.pmod(F.xxhash64(y), F.lit(SUMS)).alias("_part")).agg(
        F.count("*").alias("n"), F.count(e).alias("seen"), F.coalesce(F.sum(e * e), F.lit(0.0)).alias("sse"), F.coalesce(F.sum(F.abs(e)), F.lit(0.0)).alias("sae"), F.avg(y).alias("mean"), (F.var_pop(y) * F.count("*")).alias("m2")
    )
    own = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_part", "n", "seen", "sse", "sae", "mean", "m2"))).alias("_p"))  # SUMS at most
    total = lambda of: F.aggregate("_p", F.lit(0.0), lambda s, v: s + of(v))
    n, off = total(lambda v: v["n"].cast("double")), lambda v: v["mean"] - F.col("_p")[0]["mean"]
    apart = total(lambda v: v["n"] * off(v))
    known = lambda c: F.when(F.exists("_p", lambda v: v["seen"] > 0), total(lambda v: v[c]))
    sums = own.select(*by, n.alias("_n"), known("sse").alias("_sse"), known("sae").alias("_sae"), (total(lambda v: v["m2"] + v["n"] * off(v) * off(v)) - apart * apart / n).alias("_sst"))
    lost = F.col("_sse") / F.when(F.col("_sst") > 0, F.col("_sst"))
    return sums.select(
        *by, (1 - lost).alias("r2"), (F.col("_sse") / F.col("_n")).alias("mse"),
        F.sqrt(F.col("_sse") / F.col("_n")).alias("rmse"), (F.col("_sae") / F.col("_n")).alias("mae"), lost.alias("unexplained"),
    )


def regression_metrics(predictions: DataFrame, by: list[str] | None = None, y: str = "y", p: str = "pred") -> DataFrame:
    own = predictions.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    return own.groupBy(*(by or [])).agg(*metric_columns(F.col(y), F.col(p)))


def spearman_by_type(scores: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(type, rho) of each type and of 'all'; null where x has at most one distinct value."""
    own = scores.select(F.explode(F.array(F.col(by), F.lit("all"))).alias("type"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null")
    ranked = average_rank(average_rank(own, "x", ["type"]).withColumnRenamed("rank", "rx"), "y", ["type"]).withColumnRenamed("rank", "ry")
    return ranked.groupBy("type").agg(F.when(F.count_distinct("x") > 1, F.corr("rx", "ry")).alias("rho"))


def boxplot_stats(scores: DataFrame, by: str, value: str) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges and the number of outliers of each type."""
    own = scores.join(exact_percentiles(scores, value, [0.25, 0.5, 0.75], [by]), by)
    v, reach = F.col(value), 1.5 * (F.col("q")[2] - F.col("q")[0])
    within = (v >= F.col("q")[0] - reach) & (v <= F.col("q")[2] + reach)
    return own.groupBy(by).agg(
        F.first(F.col("q")[0]).alias("q1"), F.first(F.col("q")[1]).alias("median"), F.first(F.col("q")[2]).alias("q3"),
        F.min(F.when(within, v)).alias("low"), F.max(F.when(within, v)).alias("high"), F.sum((~within).cast("long")).alias("outliers"),
    )


def crop_tiles(pixels: DataFrame, factor: int) -> DataFrame:
    """Pixels of each tile within the largest rows and columns that are multiples of factor."""
    ends = pixels.groupBy("tile_id").agg(*[(F.floor((F.max(c) + 1) / factor) * factor).alias(f"_{c}") for c in ("row", "col")])
    return pixels.join(ends, "tile_id").filter("row < _row and col < _col").drop("_row", "_col")


def block_mean(pixels: DataFrame, width: int, values: tuple[str, ...] = ("truth", "pred")) -> DataFrame:
    """Means of non-overlapping width x width blocks after cropping to a multiple of width."""
    own = crop_tiles(pixels, width)
    return own.groupBy("tile_id", F.floor(F.col("row") / width).alias("row"), F.floor(F.col("col") / width).alias("col")).agg(*[F.avg(v).alias(v) for v in values])


def block_sums(pixels: DataFrame, widths: list[int]) -> dict[int, DataFrame]:
    """For every width, (tile_id, row, col, truth, pred): means of the whole blocks of each tile, as a pyramid.

    Pixels are read once, into sums of the blocks of those widths that no other
    width divides. Wider blocks add up the sums of the widest that divides them;
    the tiles' extents travel with the sums, so that blocks cut off by an edge are left out.
    """
    base = [w for w in widths if not any(w % v == 0 for v in widths if v < w)]
    at = {c: F.floor(F.col(c) / F.col("_w")).alias(f"_{c}") for c in ("row", "col")}
    own = pixels.withColumn("_w", F.explode(F.array(*[F.lit(w) for w in base])))
    sums = [f(c).alias(f"{k}_{c}") for c in ("truth", "pred") for k, f in (("s", F.sum), ("n", F.count))]
    first = own.groupBy("tile_id", "_w", *at.values()).agg(*sums, F.max("row").alias("rows"), F.max("col").alias("cols"))
    first = stored(first, "block-sums")
    add = [F.sum(f"{k}_{c}").alias(f"{k}_{c}") for c in ("truth", "pred") for k in "sn"] + [F.max(c).alias(c) for c in ("rows", "cols")]
    levels: dict[int, DataFrame] = {}
    for w in sorted(widths):
        if w in base:
            levels[w] = first.filter(F.col("_w") == w).drop("_w")
        else:
            of = max(v for v in levels if w % v == 0)
            step = lambda c: F.floor(F.col(f"_{c}") / (w // of)).alias(f"_{c}")  # noqa: B023, E731
            levels[w] = levels[of].groupBy("tile_id", step("row"), step("col")).agg(*add)
    out = {}
    for w, own in levels.items():
        ends = own.groupBy("tile_id").agg(*[F.floor((F.max(c) + 1) / w).alias(f"_end_{c}") for c in ("rows", "cols")])
        means = [(F.col(f"s_{c}") / F.col(f"n_{c}")).alias(c) for c in ("truth", "pred")]
        whole = own.join(ends, "tile_id").filter((F.col("_row") < F.col("_end_rows")) & (F.col("_col") < F.col("_end_cols")))
        out[w] = whole.filter("n_truth > 0 and n_pred > 0").select("tile_id", F.col("_row").alias("row"), F.col("_col").alias("col"), *means)
    return out


def across_image_r2(pixels: DataFrame, widths: list[int], demean: bool = False, clip: tuple[float, float] | None = None, impute_mean: bool = False, rescale: bool = False) -> DataFrame:
    """(width, r2) of block means of prediction against truth, over all tiles.

    rescale shifts each tile's prediction to the tile's mean truth; impute_mean
    replaces it by that mean; clip bounds it; demean takes each tile's means off.
    Pixels are read once for all widths.
    """
    out = []
    for w, b in block_sums(pixels, widths).items():
        means = b.groupBy("tile_id").agg(F.avg("truth").alias("mt"), F.avg("pred").alias("mp"))
        own = b.join(means, "tile_id")
        p = F.col("mt") if impute_mean else F.col("pred") + F.col("mt") - F.col("mp") if rescale else F.col("pred")
        p = F.least(F.greatest(p, F.lit(clip[0])), F.lit(clip[1])) if clip else p
        own = own.withColumn("pred", p)
        if demean:
            again = own.groupBy("tile_id").agg(F.avg("pred").alias("mq"))
            own = own.join(again, "tile_id").withColumns({"truth": F.col("truth") - F.col("mt"), "pred": F.col("pred") - F.col("mq")})
        out.append(regression_metrics(own, y="truth").select(F.lit(w).alias("width"), "r2"))
    return reduce(DataFrame.unionByName, out)
