"""Group assignment: administrative, by feature clusters, by land cover."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import composite_key
from ..stored import stored
from .aggregates import CLASSES, class_shares
from .prep import require_columns

#: Rows whose silhouettes are averaged at most.
SAMPLE_ROWS = 2000


def assign_admin_groups(points: DataFrame, columns: list[str]) -> DataFrame:
    """(id, grp): one or more administrative columns as a key."""
    require_columns(points, "id", *columns)
    return points.select("id", composite_key(*[F.col(c) for c in columns]).alias("grp"))


def kmeans_fit(features: DataFrame, k: int, seed: int = 42, train: DataFrame | None = None) -> tuple[DataFrame, list[np.ndarray]]:
    """kmeans_groups and its k centres."""
    own = features.select("id", array_to_vector(F.col("x").cast("array<double>")).alias("features"))
    fitted = KMeans(k=k, seed=seed).fit(own.join(train.select("id"), "id", "left_semi") if train is not None else own)
    return fitted.transform(own).select("id", F.col("prediction").alias("grp")), fitted.clusterCenters()


def kmeans_groups(features: DataFrame, k: int, seed: int = 42, train: DataFrame | None = None) -> DataFrame:
    """(id, grp): clusters of (id, x), fitted on all rows or on the train ids alone."""
    return kmeans_fit(features, k, seed, train)[0]


def nearest_centres(features: DataFrame, groups: DataFrame, centres: list[np.ndarray]) -> DataFrame:
    """(rows, groups, nearest): whether every row of (id, x) is in the group of (id, grp) whose centre is nearest."""
    d2 = [F.aggregate(F.zip_with(F.col("x").cast("array<double>"), F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for c in centres]
    met = features.join(groups, "id").withColumn("d2", F.array(*d2))
    fine = F.element_at("d2", F.col("grp") + 1) <= F.array_min("d2") * (1 + 1e-9) + 1e-12
    return met.agg(F.count("*").alias("rows"), F.count_distinct("grp").alias("groups"), F.min(fine).alias("nearest"))


def clustered(features: DataFrame, ks: list[int], seed: int = 42) -> DataFrame:
    """(id, x, grp) of (id, x), stored: the clusters of each row for every k, as an array."""
    fit, names = features.select("id", F.col("x").cast("array<double>").alias("x")).withColumn("features", array_to_vector("x")), []
    rows = stored(fit.select("id", "x"), "features").select(array_to_vector("x").alias("features"))
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol=f"_k{k}").fit(rows)
        fit, names = model.transform(fit), [*names, f"_k{k}"]
    return stored(fit.select("id", "x", F.array(*names).cast("array<int>").alias("grp")), "clustered")


def euclidean_silhouettes(placed: DataFrame, ks: list[int], seed: int = 42, sample: int = SAMPLE_ROWS) -> list[tuple[int, float]]:
    """(k, mean Euclidean silhouette) of clustered rows, for every k that gave at least two clusters.

    The mean is taken over a sample of `sample` rows, the least by a hash of the
    id (all, if there are no more); each of them is compared with all rows. The
    sample goes to all tasks, which add up its distances to the rows of every
    cluster by blocks of matrices, for all k at once; Spark adds the sums.
    """
    chosen = placed.orderBy(F.md5(F.concat(F.lit(f"silhouette|{seed}|"), F.col("id").cast("string"))), "id").limit(sample).toArrow()
    x = chosen.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(chosen), -1)
    mine = chosen.column("grp").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(chosen), -1)
    shared = placed.sparkSession.sparkContext.broadcast((x, list(ks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, every = shared.value
        own_square, sums, rows = (s * s).sum(axis=1), [np.zeros((len(s), k)) for k in every], [np.zeros(k, np.int64) for k in every]
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                v, grp = (part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) for c in ("x", "grp"))
                d = np.sqrt(np.maximum(own_square[:, None] - 2 * (s @ v.T) + (v * v).sum(axis=1), 0))
                for i, k in enumerate(every):
                    sums[i] += d @ np.eye(k)[grp[:, i]]
                    rows[i] += np.bincount(grp[:, i], minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.int32()), pa.array([m.tobytes() for m in sums], pa.binary()), pa.array([n.tobytes() for n in rows], pa.binary())], ["k", "sums", "rows"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, sums, rows = None, 0.0, 0
        for b in batches:
            for r in b.to_pylist():
                k, sums, rows = r["k"], sums + np.frombuffer(r["sums"]), rows + np.frombuffer(r["rows"], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([sums.tobytes()], pa.binary()), pa.array([rows.tobytes()], pa.binary())], ["k", "sums", "rows"])

    schema = "k int, sums binary, rows binary"
    parts = placed.select("x", "grp").mapInArrow(run, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    out = []
    for r in parts.groupBy("k", "salt").applyInArrow(add, schema).groupBy("k").applyInArrow(add, schema).orderBy("k").toLocalIterator():  # a matrix of the sample's size at a time
        rows, grp = np.frombuffer(r["rows"], np.int64), mine[:, list(ks).index(r["k"])]
        sums, at = np.frombuffer(r["sums"]).reshape(len(x), -1), np.arange(len(x))
        if np.count_nonzero(rows) < 2:
            continue
        means = np.where(rows > 0, sums / np.maximum(rows, 1), np.inf)
        inner = sums[at, grp] / np.maximum(rows[grp] - 1, 1)
        means[at, grp] = np.inf
        outer = means.min(axis=1)
        most = np.maximum(inner, outer)
        out.append((r["k"], float(np.where((rows[grp] > 1) & (most > 0), (outer - inner) / np.where(most > 0, most, 1), 0.0).mean())))
    return out


def silhouettes(features: DataFrame, ks: range, seed: int = 42, metric: str = "euclidean") -> list[tuple[int, float]]:
    """(k, mean silhouette) of every k that gives at least two clusters: euclidean against all rows, squaredEuclidean or cosine at linear cost."""
    own = stored(features.select("id", F.col("x").cast("array<double>").alias("x")), "features")
    n = own.count()
    fine = [k for k in ks if 2 <= k < n]
    if metric == "euclidean":
        return euclidean_silhouettes(clustered(own, fine, seed), fine, seed) if fine else []
    rows, out = own.select("id", array_to_vector("x").alias("features")), []
    for k in fine:
        got = KMeans(k=k, seed=seed).fit(rows).transform(rows)
        if got.select("prediction").distinct().count() > 1:
            out.append((k, ClusteringEvaluator(distanceMeasure=metric).evaluate(got)))
    return out


def best_k(features: DataFrame, ks: range, seed: int = 42, metric: str = "euclidean") -> int:
    """The k with the greatest mean silhouette, the first on ties."""
    got = silhouettes(features, ks, seed, metric)
    if not got:
        raise ValueError("no valid k")
    return max(got, key=lambda x: (x[1], -x[0]))[0]


def landcover_features(pixels: DataFrame) -> DataFrame:
    """(id, x) of tiles: their class shares."""
    shares = class_shares(pixels)
    return stored(shares.select(F.col("tile_id").alias("id"), F.array(*[F.col(f"c{c}").cast("double") for c in CLASSES]).alias("x")), "class-shares")


def landcover_groups(pixels: DataFrame, ks: range = range(2, 11), seed: int = 42) -> DataFrame:
    """(id, grp): clusters of the tiles' class shares, as many as have the greatest silhouette."""
    own = landcover_features(pixels)
    return kmeans_groups(own, best_k(own, ks, seed), seed)
