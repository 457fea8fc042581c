"""Sampling designs for an initial sample.

Draws come from a hash of seed and id, so samples do not depend on partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, haversine
from ..prefix import hash_ranked, value_ranked
from ..rng import digits, uniform
from ..stored import stored

#: Places that are sent to all tasks at most.
SPOTS = 1000


def random_sample(rows: DataFrame, n: int, seed: str, id_col: str = "id") -> DataFrame:
    """Simple random sample without replacement of exactly n rows, or all."""
    return hash_ranked(rows, seed, id_col).filter(F.col("rank") < n).drop("rank")


def train_test_split(rows: DataFrame, seed: str, frac_test: float | None = None, frac_val: float | None = None, counts: tuple[int, int, int] | None = None, id_col: str = "id") -> DataFrame:
    """Adds split: train, val or test, from fractions (rounded down) or counts (train, val, test).

    test is the first part of a random order; val is the first part of the rest.
    """
    if (frac_test is None) == (counts is None):
        raise ValueError("give exactly one of frac_test and counts")
    n = rows.count()
    if counts is not None:
        train, val, test = counts
        if train + val + test > n:
            raise ValueError(f"{counts} are more than {n} rows")
    else:
        test = int(frac_test * n)
        val = int((frac_val or 0) * (n - test))
        train = n - test - val
    split = F.when(F.col("rank") < test, "test").when(F.col("rank") < test + val, "val").when(F.col("rank") < test + val + train, "train")
    return hash_ranked(rows, seed, id_col, n=n).withColumn("split", split).filter("split is not null").drop("rank")


def split_80_20(rows: DataFrame, seed: str, id_col: str = "id") -> DataFrame:
    """20 % test, rounded up."""
    n = rows.count()
    test = -(-n // 5)
    return train_test_split(rows, seed, counts=(n - test, 0, test), id_col=id_col)


def allocate_strata(rows: DataFrame, total: int, stratum: str = "stratum", n_strata: int | None = None, fixed: list[str] | None = None, seed: str = "strata") -> DataFrame:
    """(stratum, size, target): shares of total by size, rounded by largest remainder.

    All strata, n_strata random ones, or the fixed ones; equal remainders go by
    stratum order. The table has a row for each stratum.
    """
    sizes = rows.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("size"))
    if fixed is not None:
        sizes = sizes.filter(F.col("stratum").isin(fixed))
    elif n_strata is not None:
        have = sizes.count()
        if n_strata > have:
            raise ValueError(f"{n_strata} strata asked for, {have} there")
        sizes = sizes.orderBy(digits(seed, F.col("stratum")), "stratum").limit(n_strata)
    every = Window.partitionBy()
    quota = F.col("size") * F.lit(total) / F.sum("size").over(every)
    own = sizes.withColumn("quota", quota).withColumn("floor", F.floor("quota"))
    place = F.row_number().over(Window.orderBy(F.desc(F.col("quota") - F.col("floor")), "stratum"))
    left = F.lit(total) - F.sum("floor").over(every)
    return own.withColumn("place", place).withColumn("left", left).select("stratum", "size", (F.col("floor") + (F.col("place") <= F.col("left")).cast("long")).alias("target"))


def pps_clusters(rows: DataFrame, targets: DataFrame, per_cluster: int, seed: str) -> DataFrame:
    """Clusters drawn in each stratum with chance in proportion to size, without replacement.

    rows: (id, stratum, cluster); targets: (stratum, target). A cluster gives
    least(per_cluster, size) points; clusters stop before the target would be
    passed. Returns (stratum, cluster, size, take, before, kept): kept clusters
    and, unkept, the one that would pass the target.
    The order by -ln(u) / size is that of successive draws (Efraimidis and Spirakis, 2006).
    """
    sizes = rows.groupBy("stratum", "cluster").agg(F.count("*").alias("size"))
    keyed = sizes.withColumn("_name", F.concat_ws("|", "stratum", "cluster")).withColumn("take", F.least(F.lit(per_cluster), "size").cast("long"))
    keyed = keyed.withColumn("key", -F.log(uniform(seed, F.col("_name"))) / F.col("size"))
    ranked = value_ranked(keyed, "key", seed, "_name", by=["stratum"], values=["take"])
    own = ranked.join(targets.filter("target > 0").select("stratum", "target"), "stratum").filter(F.col("before_take") < F.col("target"))
    return own.select("stratum", "cluster", "size", "take", F.col("before_take").alias("before"), (F.col("before_take") + F.col("take") <= F.col("target")).alias("kept"))


def points_of(rows: DataFrame, clusters: DataFrame, per_cluster: int, seed: str) -> DataFrame:
    """At most per_cluster random points of each cluster."""
    w = Window.partitionBy("stratum", "cluster").orderBy(digits(seed, F.col("id")), "id")
    own = rows.join(clusters.select("stratum", "cluster"), ["stratum", "cluster"])
    return own.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_cluster).drop("_n")


def cluster_sample(rows: DataFrame, total: int, per_cluster: int, seed: str, **strata) -> DataFrame:
    """(id, stratum, cluster) of a stratified cluster sample; may fall short of total, never passes it."""
    drawn = pps_clusters(rows, allocate_strata(rows, total, **strata), per_cluster, seed)
    return points_of(rows, drawn.filter("kept"), per_cluster, seed).select("id", "stratum", "cluster")


def sample_sizes(sample: DataFrame, requested: int) -> DataFrame:
    """(requested, actual): the size that was asked for, and that which the sample has."""
    return sample.agg(F.lit(requested).cast("long").alias("requested"), F.count("*").alias("actual"))


def softmax_log_weight(rows: DataFrame, distance: str, temperature: float) -> DataFrame:
    """Adds logw, the unnormalised log-weight -d / temperature of distances scaled to 0..1; equal distances weigh the same."""
    ends = rows.agg(F.min(distance).alias("_lo"), F.max(distance).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(distance) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return rows.join(F.broadcast(ends)).withColumn("logw", -scaled / float(temperature)).drop("_lo", "_hi")  # ends is one row


def softmax_neg_distance(rows: DataFrame, distance: str, temperature: float) -> DataFrame:
    """Adds p, the normalised softmax of the negative scaled distances."""
    own = softmax_log_weight(rows, distance, temperature).withColumn("_e", F.exp("logw"))
    total = own.agg(F.sum("_e").alias("_t"))
    return own.join(F.broadcast(total)).withColumn("p", F.col("_e") / F.col("_t")).drop("_e", "_t", "logw")


def convenience_points(rows: DataFrame, n: int, seed: str, temperature: float | None = None, distance: str = "distance", id_col: str = "id") -> DataFrame:
    """The n points nearest to places; with a temperature, n drawn without replacement by softmax (Gumbel order)."""
    if temperature is None:
        return value_ranked(rows, distance, seed, id_col).filter(F.col("rank") < n).drop("rank")
    gumbel = -F.log(-F.log(uniform(seed, F.col(id_col))))
    keyed = softmax_log_weight(rows, distance, temperature).withColumn("key", -(F.col("logw") + gumbel))
    return value_ranked(keyed, "key", seed, id_col).filter(F.col("rank") < n).drop("rank", "key", "logw")


def convenience_clusters(rows: DataFrame, total: int, per_cluster: int, seed: str, temperature: float | None = None, distances: DataFrame | None = None) -> DataFrame:
    """(id, cluster): clusters by the distance of their least id's point, points of each until total is reached, then exactly total.

    rows: (id, cluster, distance); distances (cluster, distance), such as those of
    centroid_distances, stand for the clusters where they are given. Raises when there are fewer points.
    """
    heads = rows.groupBy("cluster").agg(F.min_by("distance", "id").alias("distance"), F.count("*").alias("size"))
    if distances is not None:
        heads = heads.drop("distance").join(distances.select("cluster", "distance"), "cluster")
    heads = heads.withColumn("take", F.least(F.lit(per_cluster), "size").cast("long"))
    key = F.col("distance")
    if temperature is not None:
        heads = softmax_log_weight(heads, "distance", temperature)
        key = -(F.col("logw") - F.log(-F.log(uniform(seed, F.col("cluster")))))
    ranked = value_ranked(heads.withColumn("key", key), "key", seed, "cluster", values=["take"])
    chosen = ranked.filter(F.col("before_take") < total).select("cluster", F.lit("").alias("stratum"))
    own = points_of(rows.withColumn("stratum", F.lit("")), chosen, per_cluster, seed)
    have = own.count()
    if have < total:
        raise ValueError(f"{total} points asked for, {have} there")
    return random_sample(own, total, seed + "|down").select("id", "cluster")


def centroid_distances(points: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """(cluster, distance) of the mean place of each cluster of (cluster, lon, lat)."""
    middle = points.groupBy("cluster").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    return nearest_place_distance(middle, places, k).select("cluster", "distance")


def nearest_place_distance(points: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """Adds distance in metres to the nearest of the k places with most population.

    Up to SPOTS places go to all tasks. More are dealt to cubes around the points
    of the unit sphere, where neither poles nor the date line are edges: a point
    meets the places of its cube and of those around it, and is taken again with
    cubes four times as wide until the place it found is nearer than a cube's side.
    """
    top = places.orderBy(F.desc("population"), "lon", "lat").limit(k).select(F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    if k <= SPOTS:
        spots = top.agg(F.collect_list(F.struct("_lon", "_lat")).alias("_spots"))
        near = F.array_min(F.transform("_spots", lambda s: haversine(F.col("lat"), F.col("lon"), s["_lat"], s["_lon"])))
        return points.join(F.broadcast(spots)).withColumn("distance", near).drop("_spots")
    top = stored(top.filter("_lon is not null and _lat is not null").distinct(), "places")
    # a row of points may repeat: places are looked up for the distinct ones
    open_ = stored(points.select("lon", "lat").filter("lon is not null and lat is not null").distinct(), "unmatched")
    out, n = None, top.count()
    side = 2 * math.sqrt(math.pi / max(1, n))  # of as many equal squares on the sphere
    if not n:
        return points.withColumn("distance", F.lit(None).cast("double"))
    while True:
        found = stored(_in_cubes(open_, top, side), "nearest")
        sure = found.filter(F.col("distance") <= 2 * EARTH_RADIUS_M * math.asin(min(1.0, side / 2))) if side < 2 else found
        out = sure if out is None else out.unionByName(sure)
        if side >= 2:
            break
        open_ = stored(open_.join(sure, ["lon", "lat"], "left_anti"), "unmatched")
        if open_.isEmpty():
            break
        side *= 4
    return points.join(out, ["lon", "lat"], "left").select(*points.columns, "distance")


def _in_cubes(points: DataFrame, places: DataFrame, side: float) -> DataFrame:
    """(lon, lat, distance) to the nearest place within the cube of a point on the unit sphere or one beside it, where there is any."""

    def cube(lon: Column, lat: Column) -> list[Column]:
        a, b = F.radians(lat), F.radians(lon)
        return [F.floor(v / side).cast("int") for v in (F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a))]

    own = points.withColumns(dict(zip(("_x", "_y", "_z"), cube(F.col("lon"), F.col("lat")), strict=True)))
    around = places.withColumns(dict(zip(("_x", "_y", "_z"), cube(F.col("_lon"), F.col("_lat")), strict=True)))
    for c in ("_x", "_y", "_z"):
        around = around.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    metres = haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    return own.join(around, ["_x", "_y", "_z"]).groupBy("lon", "lat").agg(F.min(metres).alias("distance"))


def sample_sweep(rows: DataFrame, sizes: list[int], seeds: list[str], id_col: str = "id") -> DataFrame:
    """(run_id, size, seed, id): random samples of every size for every seed, in one job.

    A sample of one seed is a prefix of its order, so each seed is ranked once.
    """
    own = rows.select(id_col).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    own = own.withColumn("_key", F.concat_ws("|", "seed", id_col))
    ranked = hash_ranked(own, "sweep", "_key", by=["seed"]).filter(F.col("rank") < max(sizes))
    out = ranked.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes]))).filter(F.col("rank") < F.col("size"))
    return out.select(F.concat_ws("_", F.lit("random"), "size", F.lit("seed"), "seed").alias("run_id"), "size", "seed", id_col)


