"""Invariants and hand-made cases of selection, designs and inclusion probabilities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplewright.operators import designs, inclusion, selection
from samplewright.prefix import hash_ranked, value_ranked

SCHEMA = "id string, unit string, region string, grp string, labeled boolean"


@pytest.fixture(scope="module")
def points(spark):
    rows = [(str(i), f"u{i % 13}", f"r{i % 13 % 3}", f"g{i % 4}", i % 13 == 0 and i < 40) for i in range(200)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def costs(points):
    return selection.cost_region_aware(selection.unit_table(points), 1.0, 2.0)


@pytest.mark.parametrize("method", sorted(selection.METHODS))
def test_selected_points_are_unlabelled_and_within_budget(method, points, costs):
    got = selection.run_selection(method, points, costs, 6.0, "s")
    rows = {r["id"]: r for r in points.collect()}
    ids = [r["id"] for r in got.collect()]
    assert ids and len(ids) == len(set(ids)) and not any(rows[i]["labeled"] for i in ids)
    price = {r["unit"]: 0.0 if r["is_labeled"] else r["cost"] for r in costs.collect()}
    assert sum(price[u] for u in {rows[i]["unit"] for i in ids}) <= 6.0


@pytest.mark.parametrize("method", sorted(selection.METHODS))
def test_selection_does_not_depend_on_partitions(method, points, costs):
    of = lambda p: sorted(r["id"] for r in selection.METHODS[method](p, costs, 6.0, "s").collect())
    assert of(points.repartition(1)) == of(points.repartition(7))


def test_budget_must_be_possible(points, costs):
    for budget in (0, -1, 10_000):
        with pytest.raises(ValueError):
            selection.run_selection("random", points, costs, budget, "s")


def test_unit_in_two_regions_is_an_error(spark):
    bad = spark.createDataFrame([("1", "u", "a", "g", False), ("2", "u", "b", "g", False)], SCHEMA)
    with pytest.raises(Exception, match="several regions"):
        selection.unit_table(bad).collect()


def test_missing_cost_is_an_error(spark, points):
    with pytest.raises(Exception, match="no cost"):
        selection.cost_by_array(selection.unit_table(points), spark.createDataFrame([("u1", 1.0)], "unit string, cost double")).collect()


def test_ranks_are_gapless_and_ordered(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).cast("double").alias("v"))
    assert sorted(r["rank"] for r in hash_ranked(df, "x", "id").collect()) == list(range(500))
    rows = sorted(value_ranked(df, "v", "x", "id", values=["v"]).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(500)) and [r["v"] for r in rows] == sorted(r["v"] for r in rows)
    assert np.allclose([r["before_v"] for r in rows], np.cumsum([0] + [r["v"] for r in rows])[:-1])


def test_rank_plan_keeps_rows_distributed(spark, data):
    df = spark.read.parquet(f"{data}/lineitem.parquet").select(F.concat_ws("|", "l_orderkey", "l_linenumber").alias("id"))
    plan = hash_ranked(df, "x", "id", n=10**9)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_part" in plan


def test_strata_targets_sum_to_the_total(spark, points):
    rows = points.select("id", F.col("region").alias("stratum"), F.col("unit").alias("cluster"))
    for total in (0, 1, 17, 150):
        assert sum(r["target"] for r in designs.allocate_strata(rows, total).collect()) == total
    with pytest.raises(ValueError):
        designs.allocate_strata(rows, 5, n_strata=9)


def test_clusters_follow_size(spark):
    rows = spark.range(1100).select(F.col("id").cast("string").alias("id"), F.lit("s").alias("stratum"), F.when(F.col("id") < 1000, "big").otherwise("small").alias("cluster"))
    target = spark.createDataFrame([("s", 5)], "stratum string, target int")
    first = [designs.pps_clusters(rows, target, 5, f"seed{i}").filter("kept").first()["cluster"] for i in range(40)]
    assert first.count("big") > 28  # 10 of 11 expected


def test_split_counts(spark):
    df = spark.range(101).select(F.col("id").cast("string").alias("id"))
    n = {r["split"]: r["count"] for r in designs.train_test_split(df, "s", frac_test=0.2, frac_val=0.25).groupBy("split").count().collect()}
    assert n == {"test": 20, "val": 20, "train": 61}
    with pytest.raises(ValueError):
        designs.train_test_split(df, "s", counts=(90, 10, 10))


def test_pop_risk_beats_other_feasible_points(spark):
    units = spark.createDataFrame([(f"u{i}", float(1 + i % 3), i == 0) for i in range(12)], "unit string, cost double, is_labeled boolean")
    groups = spark.createDataFrame([(f"u{i}", f"g{i % 3}", 3 + i % 4) for i in range(12)], "unit string, grp string, cnt int")
    weights = spark.createDataFrame([("g0", 0.5), ("g1", 0.3), ("g2", 0.2)], "grp string, share double")
    matrix = inclusion.group_matrix(groups)
    got = inclusion.pop_risk_probabilities(units, matrix, weights, 8.0, lam=0.5, steps=25)
    s = {r["unit"]: r["s"] for r in got.collect()}
    cost = {f"u{i}": 1 + i % 3 for i in range(12)}
    assert s["u0"] == 1 and all(0 <= v <= 1 for v in s.values())
    assert sum(cost[u] * v for u, v in s.items() if u != "u0") <= 8.0 + 1e-6

    def utility(p):
        n = np.zeros(3)
        for i in range(12):
            n[i % 3] += (3 + i % 4) * p[i]
        return -sum(w * (0.5 / n[g] ** 0.5 + 0.5 / n.sum() ** 0.5) for g, w in enumerate((0.5, 0.3, 0.2)))

    best, rng = utility([s[f"u{i}"] for i in range(12)]), np.random.default_rng(0)
    for _ in range(3000):
        p = rng.random(12) * rng.random()
        p[0] = 0
        p *= min(1, 8.0 / sum(p[i] * (1 + i % 3) for i in range(12)))
        p = np.minimum(p, 1)
        p[0] = 1
        assert utility(p) <= best + 2e-3 * abs(best)


def test_greedy_takes_cheapest_first(spark):
    units = spark.createDataFrame([("a", 1.0, False), ("b", 2.0, False), ("c", 2.0, False), ("d", 9.0, True)], "unit string, cost double, is_labeled boolean")
    assert {r["unit"]: r["s"] for r in inclusion.greedy_probabilities(units, 3.0).collect()} == {"a": 1.0, "b": 0.5, "c": 0.5, "d": 1.0}
