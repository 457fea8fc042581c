"""Population preparation: joins by id, cleaning, splitting, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.labels import TRIMMED, drop_missing_label, drop_missing_rows, transform_label, valid_label
from ..prefix import counted_before, exact_percentiles
from .designs import train_test_split

# Ids that are known to be bad.
INVALID_IDS = ["615,2801", "1242,645", "539,3037", "666,2792", "1248,659", "216,2439"]


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df, or an error that names the absent columns, before any plan runs."""
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"no such column: {', '.join(absent)}")
    return df


def drop_invalid_ids(df: DataFrame, ids: list[str] = INVALID_IDS, id_col: str = "id") -> DataFrame:
    return df.filter(F.col(id_col).isNull() | ~F.col(id_col).isin(ids))


def drop_null_label(df: DataFrame, y: str, seen: Observation | None = None) -> DataFrame:
    """Rows with a label; seen gets the numbers of rows and of removed ones when the result is computed."""
    fine = F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))
    if seen is not None:
        df = df.observe(seen, F.count("*").alias("rows"), F.coalesce(F.sum((~fine).cast("long")), F.lit(0)).alias("removed"))
    return df.filter(fine)


def trim_upper(df: DataFrame, y: str, percent: float = 99.9, year: int | None = None, keep_equal: bool = False) -> DataFrame:
    """Drops rows at or above an interpolated percentile, found by rank; with year, y first becomes the age year - y."""
    own = df.withColumn(y, F.lit(year) - F.col(y)) if year is not None else df
    edge = exact_percentiles(own, y, [percent / 100]).select(F.col("q")[0].alias("_edge"))  # one row
    ok = F.col(y) <= F.col("_edge") if keep_equal else F.col(y) < F.col("_edge")
    return own.join(F.broadcast(edge)).filter(ok).drop("_edge")


def transformed(df: DataFrame, y: str, label: str, logged: bool = True) -> DataFrame:
    """Rows with y as the label's rules have it: years as ages and the top 0.1 % dropped where they ask for it, then logs."""
    own = trim_upper(df, y, year=TRIMMED[label]) if label in TRIMMED else df
    return own.withColumn(y, transform_label(F.col(y), label, logged))


def attach_labels(labels: DataFrame, features: DataFrame, id_col: str = "id") -> DataFrame:
    """Labels drive; rows without features keep nulls, to be dropped later."""
    return labels.join(features, id_col, "left")


def join_features_labels_geometry(features: DataFrame, labels: DataFrame, geometry: DataFrame, key: str, y: str) -> DataFrame:
    return drop_null_label(features.join(labels, key).join(geometry, key), y)


def multi_label_table(labels_long: DataFrame, labels: list[str], id_col: str = "id") -> DataFrame:
    """One column per label, cleaned and transformed, for ids that have all of them; from (id, label, value)."""
    value = reduce(lambda c, name: c.when(F.col("label") == name, transform_label(F.col("value"), name)), labels, F.when(F.lit(False), F.lit(0.0)))
    ok = reduce(lambda c, name: c | ((F.col("label") == name) & valid_label(F.col("value"), name)), labels, F.lit(False))
    wide = labels_long.filter(ok).withColumn("_v", value).groupBy(id_col).pivot("label", labels).agg(F.first("_v"))
    return wide.dropna(subset=labels)


def attach_admin_names(points: DataFrame, states: DataFrame, districts: DataFrame) -> DataFrame:
    """Left joins of state names by state id and of district names by state and district id."""
    return points.join(states, "state_id", "left").join(districts, ["state_id", "district_id"], "left")


def attach_admin_by_id(ids: DataFrame, admin: DataFrame, id_col: str = "id") -> DataFrame:
    return ids.join(admin.dropDuplicates([id_col]), id_col, "left")


def ids_to_rows(population: DataFrame, sample: DataFrame, id_col: str = "id") -> DataFrame:
    """Population rows whose id is sampled; unknown ids are dropped, repeated ones count once."""
    return population.join(sample.select(id_col), id_col, "left_semi")


def make_status(population: DataFrame, labeled: DataFrame, val: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """(id, status): labeled, val or unlabeled. Raises if a labelled id is unknown or also in val."""
    if not labeled.join(population, id_col, "left_anti").isEmpty():
        raise ValueError("a labelled id is not in the population")
    if val is not None and not labeled.join(val, id_col, "left_semi").isEmpty():
        raise ValueError("labelled and validation ids overlap")
    own = population.select(id_col).join(labeled.select(id_col, F.lit(True).alias("_l")).distinct(), id_col, "left")
    status = F.when(F.col("_l"), "labeled")
    if val is not None:
        own = own.join(val.select(id_col, F.lit(True).alias("_v")).distinct(), id_col, "left")
        status = status.when(F.col("_v"), "val")
    return own.select(id_col, status.otherwise("unlabeled").alias("status"))


def restrict_scored_ids(predictions: DataFrame, labels: DataFrame, id_col: str = "id") -> DataFrame:
    return predictions.join(labels.select(id_col), id_col, "left_semi")


def prepare_dataset(labels: DataFrame, features: DataFrame, label: str, seed: str, frac_test: float = 0.2, mode: str = "first") -> DataFrame:
    """Labels with features, cleaned, transformed and split into train and test."""
    own = drop_missing_rows(attach_labels(labels, features), "y", label=label, mode=mode)
    return train_test_split(own.withColumn("y", transform_label(F.col("y"), label)), seed, frac_test=frac_test)


def tiles_with_labels(tiles: DataFrame, labels_long: DataFrame, labels: list[str]) -> DataFrame:
    """One row per tile of a split with its label values and place; a missing label is null."""
    wide = labels_long.groupBy("id").pivot("label", labels).agg(F.first("value"))
    return tiles.join(wide, "id", "left")


def labels_with_grid_location(labels: DataFrame, lon_axis: DataFrame, lat_axis: DataFrame, label: str) -> DataFrame:
    from .spatial import grid_centroid

    own = drop_missing_label(grid_centroid(labels, lon_axis, lat_axis), "y", label)
    return own.withColumn("y", transform_label(F.col("y"), label))


def union_outer(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def union_tagged(tables: dict[str, DataFrame], tag: str = "sampling_type") -> DataFrame:
    return union_outer(*[t.withColumn(tag, F.lit(k)) for k, t in tables.items()])


def concat_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.unionByName(test)


def minus(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return rows.join(other.select(key), key, "left_anti")


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def first_row_per_group(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """The whole row of least order in each group."""
    gained = [c for c in rows.columns if c not in group]
    return rows.groupBy(*group).agg(F.min_by(F.struct(*gained), order).alias("_r")).select(*group, "_r.*")


def geo_sort(rows: DataFrame) -> DataFrame:
    """North first, then west; for output only."""
    return rows.orderBy(F.desc("lat"), F.asc("lon"))


def average_rank(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Adds rank, ties sharing their mean rank, within by, from counts of the distinct keys."""
    ranks = counted_before(rows, key, by).select(*by, key, (F.col("before_n") + (F.col("n") + 1) / 2).alias("rank"))
    return rows.join(ranks, [*by, key])
