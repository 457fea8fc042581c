"""Ranks, percentiles and sums without a task that sees all rows; predictions by many models."""

import re

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from samplewright import prefix, stored
from samplewright.operators import aggregates, designs, prep, ridge


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    v = np.where(rng.random(900) < 0.4, 7.0, rng.normal(size=900).round(2))
    return spark.createDataFrame([(i, "abc"[i % 3], float(x)) for i, x in enumerate(v)], "id long, g string, v double"), v


def test_value_ranks_with_many_ties(rows, monkeypatch):
    monkeypatch.setattr(prefix, "BUCKET_ROWS", 50)  # many ranges
    df, v = rows
    got = prefix.value_ranked(df, "v", "s", "id", by=["g"]).collect()
    for g in "abc":
        own = sorted((r["rank"], r["v"]) for r in got if r["g"] == g)
        assert [k for k, _ in own] == list(range(300)) and [x for _, x in own] == sorted(v["abc".index(g) :: 3])


@pytest.mark.parametrize("by", [[], ["g"]])
def test_exact_percentiles(rows, monkeypatch, by):
    monkeypatch.setattr(prefix, "BUCKET_ROWS", 50)
    df, v = rows
    shares = [0.0, 0.25, 0.333, 0.5, 0.999, 1.0]
    for r in prefix.exact_percentiles(df, "v", shares, by).collect():
        own = v["abc".index(r["g"]) :: 3] if by else v
        assert np.allclose(r["q"], np.quantile(own, shares))
    assert prefix.exact_percentiles(df.limit(0), "v", [0.5], by).count() == 0


def test_rank_plans_hold_no_window_over_all_rows(spark, rows):
    df, _ = rows
    for out in (aggregates.spearman_by_type(df.withColumn("w", F.col("id")), "g", "v", "w"), designs.convenience_points(df.withColumn("distance", F.col("v")), 5, "s"), prefix.value_ranked(df, "v", "s", "id")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window [" in line and not re.search(r"\], \[[^\]]*\], \[[^\]]*\]\s*$", line):  # no key
                assert re.search(r"Window \[[^\]]*sum\(_sum_", line)  # the sums of ranges or of levels alone meet in one task


def test_dropped_labels_are_observed(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (2.0,)], "y double")
    seen = Observation("labels")
    assert prep.drop_null_label(df, "y", seen).count() == 2
    assert seen.get == {"rows": 4, "removed": 2}


def test_mean_cosine_is_the_mean_over_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 5))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(str(i), "uv"[i % 2], [float(v) for v in r]) for i, r in enumerate(x)], "id string, unit string, x array<double>")
    pairs = [(str(i), str(j), float(unit[i] @ unit[j])) for i in range(30) for j in range(i % 2, 30, 2)]
    want = aggregates.mean_similarity_per_unit(spark.createDataFrame(pairs, "row_id string, col_id string, sim double"), df.select(F.col("id").alias("row_id"), "unit"))
    got = {r["unit"]: r["sim"] for r in aggregates.mean_cosine_per_unit(df).collect()}
    assert got == pytest.approx({r["unit"]: r["sim"] for r in want.collect()})


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("on", [[], ["run_id"]])
def test_predictions_by_many_models(spark, monkeypatch, small, on):
    if not small:
        monkeypatch.setattr(ridge, "MODEL_BYTES", 100)  # three groups of models, a pass over the rows for each
    rng = np.random.default_rng(3)
    x, coef = rng.normal(size=(40, 3)), rng.normal(size=(7, 3))
    rows = [(i, "pq"[i % 2], [float(v) for v in r]) for i, r in enumerate(x)] + [(90, "p", None), (91, "p", [1.0, None, 2.0])]
    models = [("pqr"[k % 3], k / 2, float(k), [float(v) for v in c]) for k, c in enumerate(coef)]
    rows, models = spark.createDataFrame(rows, "id int, run_id string, x array<double>"), spark.createDataFrame(models, "run_id string, lam double, intercept double, coef array<double>")
    rows, models = (rows, models) if on else (rows.drop("run_id"), models)
    got = {(r["id"], r["lam"]): r["pred"] for r in ridge.ridge_predict(rows, models, on, -2.0, 4.0).collect()}
    want = {(i, k / 2): float(np.clip(k + coef[k] @ r, -2, 4)) for i, r in enumerate(x) for k in range(7) if not on or "pq"[i % 2] == "pqr"[k % 3]}
    assert {k: v for k, v in got.items() if v is not None} == pytest.approx(want)
    assert {k for k, v in got.items() if v is None} == {(i, k / 2) for i in (90, 91) for k in range(7) if not on or k % 3 == 0}


def test_sums_of_wide_rows_are_bounded(spark, monkeypatch):
    df = spark.range(200).select(F.concat(F.lit("r"), F.col("id") % 3).alias("run_id"), (F.col("id") % 4).cast("int").alias("fold"), F.array(F.col("id") * 1.0, F.col("id") % 7 * 1.0).alias("x"), (F.col("id") % 5 * 1.0).alias("y"))
    sums = lambda **o: {(r["run_id"], r["fold"], r["i"], r["j"]): np.frombuffer(r["part"]) for r in ridge.sufficient_stats(df, **o).collect()}
    want = sums()
    monkeypatch.setattr(ridge, "HELD_BYTES", 8 * 16 * 2)  # two sums a task
    got = sums()
    assert len(want) == 12 and all((got[k] == v).all() for k, v in want.items())
    monkeypatch.setattr(ridge, "HELD_BYTES", 8 * 4)  # one tile of two columns at a time: a pass over the rows for each
    parts = sums(tile=2)
    assert len(parts) == 36 and {len(v) for v in parts.values()} == {4}
    for r, f, *_ in want:
        assert (ridge.matrix_of(4, 2, {(i, j): parts[r, f, i, j] for i, j in ridge.tiles(4, 2)}).ravel() == want[r, f, 0, 0]).all()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    far = SimpleNamespace(sparkContext=SimpleNamespace(getConf=dict, master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stored.shared_folder(far)
