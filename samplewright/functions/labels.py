"""Labels: cleaning rules, transforms and prediction bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING = -999.0
#: Nightlights above this are not valid.
NIGHTLIGHTS_MAX = 629.0

# Fixed values: (label, column, variable, sampling, logged, raw bounds, log bounds, lambda grid as log10 from, log10 to, points).
LABELS = [
    ("housing", "price_per_sqft", "log_price_per_sqft", "POP", True, 10.0, 13421.0, 2.4, 9.5, -3.0, 3.0, 9),
    ("nightlights", "y", "log_nightlights", "POP", True, 0.0, None, 0.0, None, -3.0, 3.0, 9),
    ("elevation", "elevation", "meters", "UAR", False, -86.0, 4418.0, 0.0, None, -3.0, 3.0, 9),
    ("population", "population", "log_population", "UAR", True, 0.0, 30000.0, 0.0, 10.0, -3.0, 3.0, 7),
    ("treecover", "treecover", "treecover", "UAR", False, 0.0, 100.0, 0.0, 4.6, -3.0, 3.0, 9),
    ("income", "income", "income", "POP", False, 0.0, 300000.0, 0.0, 13.0, -3.0, 3.0, 9),
    ("roads", "length", "length", "POP", False, 0.0, 20000.0, 0.0, 10.0, -3.0, 3.0, 9),
    ("B08303", "Val", "MinToWork", "POP", False, 0.0, None, None, None, -3.0, 3.0, 5),
    ("B15003", "Val", "PctBachDeg", "POP", False, 0.0, 100.0, None, None, -3.0, 3.0, 5),
    ("B19013", "Val", "MedHHIncome", "POP", False, 0.0, None, None, None, -3.0, 3.0, 5),
    ("B19301", "Val", "MedPerCapIncome", "POP", False, 0.0, None, None, None, -3.0, 3.0, 5),
    ("C17002", "Val", "PctBelowPov", "POP", False, 0.0, 100.0, None, None, -3.0, 3.0, 5),
    ("B22010", "Val", "PctFoodStamp", "POP", False, 0.0, 100.0, None, None, -3.0, 3.0, 5),
    ("B25001", "Val", "NumHouseUnits", "POP", False, 0.0, 2641.0, None, None, -3.0, 3.0, 5),
    ("B25002", "Val", "PctVacant", "POP", False, 0.0, 100.0, None, None, -3.0, 3.0, 5),
    ("B25035", "Val", "YrBuilt", "POP", False, 0.0, 75.3, None, None, -1.0, 3.0, 5),
    ("B25017", "Val", "NumHouseRooms", "POP", False, 0.0, None, None, None, -3.0, 3.0, 5),
    ("B25077", "Val", "MedHouseValue", "POP", False, 0.0, None, None, None, -3.0, 3.0, 5),
    ("B25071", "Val", "PctIncomeRent", "POP", False, 0.0, 100.0, None, None, 2.0, 5.0, 4),
]
#: Labels whose top 0.1 % is dropped, and the year from which an age is counted, where y is a year. Fixed values.
TRIMMED = {"B25001": None, "B25035": 2015}
SPEC_SCHEMA = "label string, colname string, variable string, sampling string, logged boolean, lo double, hi double, log_lo double, log_hi double, lambda_from double, lambda_to double, n_lambda int"


def label_spec(spark: SparkSession) -> DataFrame:
    """One row per label: column, sampling, whether it is logged, bounds of predictions and the grid of lambdas."""
    return spark.createDataFrame(LABELS, SPEC_SCHEMA)


def lambda_grid(spark: SparkSession, label: str, chosen: DataFrame | None = None) -> DataFrame:
    """(lambda): the label's grid, or the distinct values chosen before, from (label, lambda)."""
    if chosen is not None:
        return chosen.filter(F.col("label") == label).select("lambda").distinct()
    own = label_spec(spark).filter(F.col("label") == label)
    steps = own.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_lambda") - 1)))
    return steps.select(F.pow(F.lit(10.0), F.col("lambda_from") + (F.col("lambda_to") - F.col("lambda_from")) * F.col("i") / (F.col("n_lambda") - 1)).alias("lambda"))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def valid_label(y: Column, label: str | None = None) -> Column:
    """Neither null, NaN, infinite nor -999; nightlights at most 629."""
    ok = finite(y) & (y != MISSING)
    return ok & (y <= NIGHTLIGHTS_MAX) if label == "nightlights" else ok


def drop_missing_label(df: DataFrame, y: str, label: str | None = None) -> DataFrame:
    return df.filter(valid_label(F.col(y), label))


def drop_missing_rows(df: DataFrame, y: str, x: str = "x", lon: str = "lon", lat: str = "lat", label: str | None = None, mode: str = "first") -> DataFrame:
    """Also drops rows with a missing feature or place: 'first' tests the first feature and lon alone, 'all' every one."""
    if mode == "first":
        ok = finite(F.get(F.col(x), F.lit(0))) & finite(F.col(lon))
    elif mode == "all":
        ok = F.forall(F.col(x), finite) & finite(F.col(lon)) & finite(F.col(lat))
    else:
        raise ValueError(mode)
    return drop_missing_label(df, y, label).filter(ok)


def transform_label(y: Column, label: str, logged: bool = True) -> Column:
    """log(y) for housing, y for elevation, log(y + 1) for the others; y where not logged."""
    if not logged or label == "elevation":
        return y
    return F.log(y) if label == "housing" else F.log(y + 1)


def clip(y: Column, lo: Column | float | None = None, hi: Column | float | None = None) -> Column:
    """y clamped to bounds, either of which may be null; null stays null."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v).cast("double")
    return F.when(y.isNotNull(), F.least(F.greatest(y, as_col(lo)), as_col(hi)))


def clean_outcome(df: DataFrame, outcome: str) -> DataFrame:
    """Rules by outcome: housing log price without nulls; income and population without -999; logs; length becomes roads."""
    if outcome == "housing":
        return df.filter(F.col("price_per_sqft").isNotNull()).withColumn("log_price_per_sqft", F.log("price_per_sqft"))
    if outcome in ("income", "population"):
        out = df.filter(F.col(outcome) != MISSING)
        return out.withColumn("log_population", F.log(F.col("population") + 1)) if outcome == "population" else out
    if outcome == "nightlights":
        return df.withColumn("log_nightlights", F.log(F.col("y") + 1))
    if outcome == "roads":
        return df.withColumnRenamed("length", "roads")
    return df
