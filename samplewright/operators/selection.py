"""Cost models and budgeted selection of points or units.

points has (id, unit, region, grp, labeled); a unit lies in one region. Every
selector works in an order without replacement and stops before the budget
would be passed; as costs are not negative, that is a running sum and a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..prefix import hash_ranked, running_sums, value_ranked
from ..rng import digits, uniform


def unit_table(points: DataFrame) -> DataFrame:
    """(unit, region, n_points, n_labeled, is_labeled); raises when a unit has several regions."""
    return points.groupBy("unit").agg(
        F.when(F.count_distinct("region") > 1, F.raise_error(F.concat(F.lit("several regions in unit "), F.first("unit")))).otherwise(F.min("region")).alias("region"),
        F.count("*").alias("n_points"),
        F.sum(F.col("labeled").cast("long")).alias("n_labeled"),
        F.max("labeled").alias("is_labeled"),
    )


def unit_attribute(points: DataFrame, column: str) -> DataFrame:
    """(unit, value): the one value of a column in each unit; raises when there are several."""
    several = F.raise_error(F.concat(F.lit(f"several values of {column} in unit "), F.first("unit")))
    return points.groupBy("unit").agg(F.when(F.count_distinct(column) > 1, several).otherwise(F.min(column)).alias("value"))


def unit_group_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("unit", "grp").agg(F.count("*").alias("cnt"))


def labeled_units(points: DataFrame) -> DataFrame:
    return points.filter("labeled").select("unit").distinct()


def labeled_regions(points: DataFrame) -> DataFrame:
    return points.filter("labeled").select("region").distinct()


def cost_uniform(units: DataFrame, cost: float = 1.0) -> DataFrame:
    return units.withColumn("cost", F.lit(float(cost)))


def cost_by_array(units: DataFrame, costs: DataFrame, key: str = "unit") -> DataFrame:
    """Costs given by key; a missing one is an error."""
    joined = units.join(costs.select(key, "cost"), key, "left")
    return joined.withColumn("cost", F.when(F.col("cost").isNull(), F.raise_error(F.concat(F.lit("no cost for "), F.col(key)))).otherwise(F.col("cost")).cast("double"))


def cost_region_aware(units: DataFrame, c1: float = 1.0, c2: float = 2.0) -> DataFrame:
    """c1 for an unlabelled unit whose region holds a labelled point, else c2."""
    known = units.filter("is_labeled").select("region").distinct().withColumn("_known", F.lit(True))
    near = ~F.col("is_labeled") & F.col("_known").isNotNull()
    return units.join(known, "region", "left").withColumn("cost", F.when(near, float(c1)).otherwise(float(c2))).drop("_known")


def cost_of(units: DataFrame, selected: Column) -> DataFrame:
    """(total_cost, baseline_cost, added_cost) of a selection of units."""
    total, base = F.sum(F.when(selected, F.col("cost")).otherwise(0.0)), F.sum(F.when(F.col("is_labeled"), F.col("cost")).otherwise(0.0))
    return units.agg(total.alias("total_cost"), base.alias("baseline_cost"), (total - base).alias("added_cost"))


def within_budget(before: str, cost: str, budget: float) -> Column:
    """Rows whose running cost, their own included, does not pass the budget."""
    return F.col(before) + F.col(cost) <= F.lit(float(budget)) * (1 + 1e-9)


def cap_per_unit(points: DataFrame, k: int, seed: str) -> DataFrame:
    """At most k points of each unit, by the hash of seed and id."""
    w = Window.partitionBy("unit").orderBy(digits(seed, F.col("id")), "id")
    return points.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def select_random(points: DataFrame, budget: int, seed: str) -> DataFrame:
    """Exactly `budget` random unlabelled points, or all if there are fewer."""
    return hash_ranked(points.filter("not labeled"), seed, "id").filter(F.col("rank") < budget).select("id")


def _charged(order: list[Column], free: DataFrame, costs: DataFrame) -> DataFrame:
    """Unlabelled points with charge: the unit's cost on its first point in the order, 0 after and for labelled units."""
    own = free.join(costs.select("unit", "is_labeled", "cost"), "unit")
    first = F.row_number().over(Window.partitionBy("unit").orderBy(*order)) == 1
    return own.withColumn("charge", F.when(first & ~F.col("is_labeled"), F.col("cost")).otherwise(0.0))


def select_points_cost_aware(points: DataFrame, costs: DataFrame, budget: float, seed: str) -> DataFrame:
    """Random points; a unit is paid for when its first point is taken, labelled units are free."""
    own = _charged([digits(seed, F.col("id")), F.col("id")], points.filter("not labeled"), costs)
    return hash_ranked(own, seed, "id", values=["charge"]).filter(within_budget("before_charge", "charge", budget)).select("id", "unit", "charge")


def select_units_cost_aware(points: DataFrame, costs: DataFrame, budget: float, seed: str, per_unit: int = 10) -> DataFrame:
    """Random unlabelled units up to the budget, and at most per_unit unlabelled points of each."""
    ranked = hash_ranked(costs.filter("not is_labeled"), seed, "unit", values=["cost"])
    units = ranked.filter(within_budget("before_cost", "cost", budget)).select("unit", "cost")
    return cap_per_unit(points.filter("not labeled").join(units, "unit"), per_unit, seed).select("id", "unit", "cost")


def _in_groups(points: DataFrame, seed: str) -> DataFrame:
    """Unlabelled points with rn, their place in a random order of their group, and have, the group's labelled points."""
    counts = points.groupBy("grp").agg(F.sum(F.col("labeled").cast("long")).alias("have"), F.count("*").alias("size"))
    ranked = hash_ranked(points.filter("not labeled").withColumn("grp", F.coalesce("grp", F.lit(""))), seed, "id", by=["grp"])
    return ranked.withColumn("rn", F.col("rank") + 1).drop("rank").join(counts.withColumn("grp", F.coalesce("grp", F.lit(""))), "grp").withColumn("ug", digits(seed, F.col("grp")))


def _by_turn(own: DataFrame, costs: DataFrame, budget: float, levels: list[str]) -> DataFrame:
    paid = _charged([*[F.col(x) for x in levels], F.col("key"), F.col("ug"), F.col("id")], own, costs)
    return running_sums(paid, [], levels, ["key", "ug", "id"], ["charge"]).filter(within_budget("before_charge", "charge", budget)).select("id", "unit", "grp", "charge")


def select_stratified(points: DataFrame, costs: DataFrame, budget: float, seed: str) -> DataFrame:
    """Points one by one from the group with fewest labelled ones; ties by a hash of the group."""
    own = _in_groups(points, seed).withColumn("key", F.col("have") + F.col("rn") - 1)
    return _by_turn(own.withColumns({"_k": F.floor(F.col("key") / 2**20), "_l": F.floor(F.col("key") / 1024)}), costs, budget, ["_k", "_l", "key"])


def select_match_population(points: DataFrame, costs: DataFrame, budget: float, seed: str) -> DataFrame:
    """Points one by one from the group furthest under its share of the population.

    Groups take turns by labelled points over population size; an over-represented
    group waits until the others have caught up.
    """
    own = _in_groups(points, seed).withColumn("key", (F.col("have") + F.col("rn")) / F.col("size"))
    own = own.withColumns({"_l": F.floor(F.col("key") * 1024), "_m": F.floor(F.col("key") * 2.0**24)})
    return _by_turn(own, costs, budget, ["_l", "_m"])


def select_shuffled_groups(points: DataFrame, costs: DataFrame, budget: float, seed: str) -> DataFrame:
    """Points one by one from a random group that is not exhausted.

    The arrivals of a group are the running sums of exponential gaps, so the next
    arrival among all groups is from each with equal chance.
    """
    free = points.filter("not labeled").withColumn("grp", F.coalesce("grp", F.lit("")))
    gaps = free.withColumn("gap", -F.log(uniform(seed + "|gap", F.col("id"))))
    own = hash_ranked(gaps, seed, "id", by=["grp"], values=["gap"]).withColumn("key", F.col("before_gap") + F.col("gap"))
    own = own.withColumn("ug", digits(seed, F.col("grp"))).withColumns({"_k": F.floor(F.col("key") / 2**16), "_l": F.floor(F.col("key") / 64), "_m": F.floor(F.col("key") * 16)})
    return _by_turn(own, costs, budget, ["_k", "_l", "_m"])


def selection_metadata(points: DataFrame, costs: DataFrame, selection: DataFrame, seed: str) -> DataFrame:
    """One row: baseline and added cost, selected points and units, recomputed from the status before and after."""
    after = points.join(selection.select("id", F.lit(True).alias("_in")), "id", "left")
    units = after.groupBy("unit").agg(F.max("labeled").alias("before"), F.max(F.col("labeled") | F.col("_in").isNotNull()).alias("after"), F.sum(F.col("_in").isNotNull().cast("long")).alias("n"))
    own = units.join(costs.select("unit", "cost"), "unit")
    base, total = F.sum(F.when(F.col("before"), F.col("cost")).otherwise(0.0)), F.sum(F.when(F.col("after"), F.col("cost")).otherwise(0.0))
    return own.agg(
        base.alias("baseline_cost"),
        (total - base).alias("added_cost"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_selected"),
        F.sum(F.col("after").cast("long") - F.col("before").cast("long")).alias("n_new_units"),
        F.lit(seed).alias("seed"),
    )


METHODS = {
    "random_unit": select_units_cost_aware,
    "random_point": select_points_cost_aware,
    "stratified": select_stratified,
    "match_population_proportion": select_match_population,
    "shuffled_groups": select_shuffled_groups,
}


def run_selection(method: str, points: DataFrame, costs: DataFrame, budget: float, seed: str, **options) -> DataFrame:
    """Selection by name, simple or optimised; the budget must be positive and below the number of unlabelled points."""
    free = points.filter("not labeled").count()
    if not 0 < budget < free:
        raise ValueError(f"budget {budget} is not between 0 and {free}")
    if method == "random":
        return select_random(points, int(budget), seed)
    if method in METHODS:
        return METHODS[method](points, costs, budget, seed, **options)
    from .inclusion import select_optimised

    return select_optimised(method, points, costs, budget, seed, **options)


def top_by(rows: DataFrame, key: str, n: int, seed: str, id_col: str = "id") -> DataFrame:
    """The n rows of least key, ties by hash; distributed, for n of any size."""
    return value_ranked(rows, key, seed, id_col).filter(F.col("rank") < n).drop("rank")
