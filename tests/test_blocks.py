"""Matrices by blocks, silhouettes, pyramids of blocks, places on the sphere, sinks that can be repeated, tables that go."""

import math
import os
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplewright import sources, stored
from samplewright.operators import aggregates, designs, features, groups, inclusion, prep
from samplewright.plans import QUERIES, selecting
from samplewright.plans import fixtures as fx


def cosines(x, grp):
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    unit = np.where(length > 0, x / np.where(length > 0, length, 1), 0)
    return np.clip(unit @ unit.T, 0, 1) * (grp[:, None] == grp[None, :])


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(12)
    x, grp = rng.normal(size=(300, 5)).round(2), np.array(["hot"] * 200 + ["b"] * 99 + ["c"])
    x[7] = 0.0
    df = spark.createDataFrame([(f"u{i}", str(grp[i]), x[i].tolist()) for i in range(300)], "unit string, grp string, x array<double>")
    return df, cosines(x, grp)


@pytest.mark.parametrize("block_bytes", [1, 1 << 21])
def test_products_of_blocks_equal_the_matrix(spark, vectors, block_bytes):
    df, m = vectors
    blocks = inclusion.CosineBlocks(df, block_bytes)
    assert block_bytes > 1 or blocks.blocks.count() > 5
    s = np.random.default_rng(1).uniform(size=300)
    s[5] = 0.0
    given = spark.createDataFrame([(f"u{i}", float(v)) for i, v in enumerate(s) if i != 5], "unit string, s double")
    got = {r["unit"]: r["product"] for r in blocks.times(given, "s").collect()}
    want = m @ s
    assert all(np.isclose(got.get(f"u{i}", 0.0), want[i]) for i in range(300))
    value = inclusion.utility_diversity(given, blocks).first()["utility"]
    assert value == pytest.approx(100 * s.sum() - s @ m @ s - 1e-4 * s @ s)
    plan = blocks.times(given, "s")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_diversity_is_within_its_gap_of_the_best(spark, vectors):
    """The duality gap, recomputed by numpy from the returned probabilities; blocks and a table of pairs agree."""
    df, m = vectors
    cost, labeled = 1.0 + np.arange(300) % 4, np.arange(300) % 50 == 0
    units = spark.createDataFrame([(f"u{i}", float(cost[i]), bool(labeled[i])) for i in range(300)], "unit string, cost double, is_labeled boolean")
    pairs = spark.createDataFrame([(f"u{i}", f"u{j}", float(m[i, j])) for i in range(300) for j in range(300) if m[i, j]], "row_id string, col_id string, sim double")
    for similarity in (inclusion.CosineBlocks(df, 1), pairs):
        got = {r["unit"]: r["s"] for r in inclusion.diversity_probabilities(units, similarity, 120.0, gap=0.1).collect()}
        s = np.array([got[f"u{i}"] for i in range(300)])
        assert (s[labeled] == 1).all() and (s >= 0).all() and (s <= 1).all() and cost[~labeled] @ s[~labeled] <= 120 * (1 + 1e-9)
        gain = 100 - 2 * (m @ s + 1e-4 * s)
        best, left = np.where(labeled, 1.0, 0.0), 120.0
        for i in sorted(np.flatnonzero(~labeled & (gain > 0)), key=lambda i: -gain[i] / cost[i]):
            best[i] = min(1.0, left / cost[i])
            left -= best[i] * cost[i]
        assert gain @ (best - s) <= 0.1001 * np.abs(gain * s).sum()


def test_pop_risk_is_within_its_gap_of_the_best(spark, data):
    """inclusion_pop_risk: feasible, and no feasible direction gains more than the gap."""
    got = {r["unit"]: r["s"] for r in QUERIES["inclusion_pop_risk"](spark, data).collect()}
    units = {r["unit"]: r for r in selecting._units(spark, data).collect()}
    matrix, shares = selecting._risk(spark, data)
    share = {r["grp"]: r["share"] for r in shares.collect()}
    rows = [(r["unit"], r["grp"], r["a"]) for r in matrix.collect() if r["grp"] in share]
    assert set(got) == set(units) and all(0 <= s <= 1 for s in got.values()) and all(got[u] == 1 for u, r in units.items() if r["is_labeled"])
    spent = sum(r["cost"] * got[u] for u, r in units.items() if not r["is_labeled"])
    n = dict.fromkeys(share, 0.0)
    for u, g, a in rows:
        n[g] += a * got[u]
    total, lam = sum(n.values()), 0.5
    slope = {g: w * lam / 2 * n[g] ** -1.5 + sum(share.values()) * (1 - lam) / 2 * total**-1.5 for g, w in share.items()}
    gain = dict.fromkeys(units, 0.0)
    for u, g, a in rows:
        gain[u] += a * slope[g]
    best, left = {u: float(r["is_labeled"]) for u, r in units.items()}, spent
    for u in sorted((u for u, r in units.items() if not r["is_labeled"]), key=lambda u: -gain[u] / units[u]["cost"]):
        best[u] = min(1.0, left / units[u]["cost"])
        left -= best[u] * units[u]["cost"]
    value = sum(w * (lam / math.sqrt(n[g]) + (1 - lam) / math.sqrt(total)) for g, w in share.items())
    assert sum(gain[u] * (best[u] - got[u]) for u in units) <= 1.01e-4 * value


def test_diversity_reaches_its_gap_in_few_products(spark):
    """The gap of 1e-4 within 30 steps, each of one product: Frank-Wolfe steps took over 500."""
    x = np.random.default_rng(3).normal(size=(300, 64))
    df = spark.createDataFrame([(f"u{i}", "all", x[i].tolist()) for i in range(300)], "unit string, grp string, x array<double>")
    units = spark.createDataFrame([(f"u{i}", 1.0 + i % 4, False) for i in range(300)], "unit string, cost double, is_labeled boolean")
    blocks, made = inclusion.CosineBlocks(df), []

    def counted(weights, value, times=blocks.times):
        made.append(value)
        return times(weights, value)

    blocks.times = counted
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        got = inclusion.diversity_probabilities(units, blocks, 60.0, weight=10.0, steps=30)
    assert len(made) <= 31
    proof = inclusion.diversity_certificate(units, got, blocks, 60.0, weight=10.0).first()
    assert proof["feasible"] and proof["gap_met"] and proof["spent"] == pytest.approx(60.0)


def test_pop_risk_needs_few_steps_and_one_table(spark, data):
    """The gap of 1e-4 within 20 steps, none of which stores or broadcasts units."""
    folder = stored.shared_folder(spark)
    matrix, shares = selecting._risk(spark, data)
    units, before = selecting._units(spark, data), len(os.listdir(folder))
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        got = inclusion.pop_risk_probabilities(units, matrix, shares, 900.0, steps=20)
    assert len(os.listdir(folder)) - before == 1
    plan = got._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_climbs_leave_few_tables(spark, vectors):
    df, _ = vectors
    folder = stored.shared_folder(spark)
    units = spark.createDataFrame([(f"u{i}", 1.0 + i % 4, False) for i in range(300)], "unit string, cost double, is_labeled boolean")
    blocks, before = inclusion.CosineBlocks(df), len(os.listdir(folder))
    with pytest.warns(RuntimeWarning, match="gap"):
        inclusion.diversity_probabilities(units, blocks, 60.0, gap=-1.0, steps=3)
    assert len(os.listdir(folder)) - before == 1  # the last step, which the result reads


def brute_silhouette(x, grp):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i, g in enumerate(grp):
        own = grp == g
        if own.sum() < 2:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, grp == h].mean() for h in set(grp) if h != g)
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_euclidean_silhouettes_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 4)) + 4 * rng.integers(0, 3, (500, 1))
    df = spark.createDataFrame([(str(i), x[i].tolist()) for i in range(500)], "id string, x array<double>").repartition(5)
    placed = groups.clustered(df, [2, 3, 9])
    got, grp = dict(groups.euclidean_silhouettes(placed, [2, 3, 9])), {r["id"]: r["grp"] for r in placed.collect()}
    assert sorted(got) == [2, 3, 9]
    for at, k in enumerate(got):
        assert got[k] == pytest.approx(brute_silhouette(x, np.array([grp[str(i)][at] for i in range(500)])), abs=1e-9)
    assert groups.best_k(df, range(2, 4)) == 3
    assert groups.silhouettes(df.limit(2), range(2, 4)) == [] and len(groups.silhouettes(df, range(2, 3), metric="cosine")) == 1
    part = dict(groups.euclidean_silhouettes(placed, [2, 3, 9], sample=200))
    assert part[3] == pytest.approx(got[3], abs=0.05)


def test_landcover_and_kmeans_groups_are_nearest(spark, data):
    for own, k in ((fx.features(spark, data), 6), (groups.landcover_features(fx.pixels(spark, data)), 4)):
        got, centres = groups.kmeans_fit(own, k)
        c = np.array(centres)
        grp = {r["id"]: r["grp"] for r in got.collect()}
        for r in own.collect():
            d = ((np.array(r["x"], float) - c) ** 2).sum(axis=1)
            assert d[grp[r["id"]]] <= d.min() + 1e-9
    shares = {r["id"]: r["grp"] for r in QUERIES["landcover_groups"](spark, data).collect()}
    assert set(shares) == {r["tile_id"] for r in aggregates.class_shares(fx.pixels(spark, data)).collect()} and len(set(shares.values())) >= 2


def test_patch_filters_equal_numpy(spark, data):
    """patch_filter_features: the chosen patches normed, whitened and convolved by numpy."""
    images = fx.features(spark, data).select("id", "x")
    rows = features.random_patches(images, 8, 3, 8, 1, "patch").orderBy("id", "pos").collect()
    p = np.array([r["p"] for r in rows])
    p = p - p.mean(axis=1, keepdims=True)
    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-8)
    z = p - p.mean(axis=0)
    values, vectors = np.linalg.eigh(z.T @ z / len(p))
    want = z @ vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0) + 1e-3)) @ vectors.T
    assert np.allclose(features.patch_filters(images, 8, 3, 8, 1, "patch").reshape(8, -1), want, atol=1e-6)
    x = {r["id"]: np.array(r["x"], float).reshape(8, 8) for r in images.collect()}
    for r in QUERIES["patch_filter_features"](spark, data).collect()[:25]:
        conv = np.array([[[(x[r["id"]][i : i + 3, j : j + 3] * f.reshape(3, 3)).sum() for j in range(6)] for i in range(6)] for f in want])
        both = np.maximum(np.concatenate([conv, -conv]) - 0.05, 0).mean(axis=(1, 2))
        assert np.allclose(r["x"], both, atol=1e-5)
    flat = spark.createDataFrame([("a", 0, [1.0, 1.0, 1.0, 1.0]), ("b", 0, [0.0, 1.0, 0.0, 1.0])], "id string, pos int, p array<double>")
    assert features.whitened_patches(flat).count() == 2 and features.whitened_patches(flat.limit(0)).count() == 0


def test_pyramid_of_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    shape = {"a": (12, 13), "b": (7, 6), "c": (5, 24), "d": (3, 3)}
    own = {t: rng.normal(size=(2, *s)) + k for k, (t, s) in enumerate(shape.items())}
    rows = [(t, r, c, float(v[0, r, c]), float(v[1, r, c])) for t, v in own.items() for r in range(v.shape[1]) for c in range(v.shape[2])]
    px = spark.createDataFrame(rows, "tile_id string, row int, col int, truth double, pred double")
    widths = [6, 2, 3, 4, 12]
    df = aggregates.across_image_r2(px, widths, demean=True)
    got = {r["width"]: r["r2"] for r in df.collect()}
    for w in widths:
        t, p = [], []
        for v in own.values():
            n, m = v.shape[1] // w, v.shape[2] // w
            b = v[:, : n * w, : m * w].reshape(2, n, w, m, w).mean(axis=(2, 4)).reshape(2, -1)
            b = b - b.mean(axis=1, keepdims=True) if b.size else b
            t, p = [*t, *b[0]], [*p, *b[1]]
        t, p = np.array(t), np.array(p)
        want = 1 - ((t - p) ** 2).sum() / ((t - t.mean()) ** 2).sum() if len(t) > 1 else None
        assert got[w] == pytest.approx(want) if want is not None else got[w] is None or got[w] != got[w]
    blocks = {(r["tile_id"], r["row"], r["col"]): r["truth"] for r in aggregates.block_sums(px, [2, 4])[4].collect()}
    assert blocks == {k: pytest.approx(v) for k, v in {(r["tile_id"], r["row"], r["col"]): r["truth"] for r in aggregates.block_mean(px, 4).collect()}.items()}
    assert "Scan ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()  # the pixels were read before, once


@pytest.mark.parametrize("cubes", [False, True])
def test_nearest_places_equal_brute_force(spark, monkeypatch, cubes):
    monkeypatch.setattr(designs, "SPOTS", 0 if cubes else 1000)
    rng = np.random.default_rng(9)
    spots = [(float(x), float(y)) for x, y in zip(rng.uniform(-180, 180, 150), rng.uniform(-90, 90, 150), strict=True)] + [(179.99, 10.0), (0.0, 90.0), (12.0, -89.9), (5.0, 5.0), (5.0, 5.0)]
    places = [(float(x), float(y), int(p)) for x, y, p in zip(rng.uniform(-180, 180, 80), rng.uniform(-60, 89, 80), rng.integers(0, 1000, 80), strict=True)] + [(-179.99, 10.0, 2000)]
    points = spark.createDataFrame([(i, *p, "x") for i, p in enumerate(spots)], "id int, lon double, lat double, distance_to string")
    df = spark.createDataFrame(places, "lon double, lat double, population int")
    for k in (1, 30, 200):
        top = sorted(places, key=lambda p: (-p[2], p[0], p[1]))[:k]
        got = {r["id"]: r["distance"] for r in designs.nearest_place_distance(points, df, k).collect()}
        assert len(got) == len(spots)
        for i, (lon, lat) in enumerate(spots):
            a, b = math.radians(lat), [math.radians(p[1]) for p in top]
            h = [math.sin((v - a) / 2) ** 2 + math.cos(a) * math.cos(v) * math.sin(math.radians(p[0] - lon) / 2) ** 2 for v, p in zip(b, top, strict=True)]
            assert got[i] == pytest.approx(2 * 6_371_000 * math.asin(math.sqrt(min(1.0, min(h)))), rel=1e-9)


def test_writes_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "status")
    df = spark.createDataFrame([("a", "labeled"), ("b", "unlabeled")], "id string, status string")
    for run, episode in (("r1", 0), ("r1", 1), ("r2", 0), ("r1", 1), ("r1", 0)):
        sources.write_status(df, path, run, episode)
    assert spark.read.parquet(path).groupBy("run_id", "episode").count().filter("count = 2").count() == 3
    assert [r["run_id"] for r in sources.done_runs(spark, path).collect()] == ["r1"]
    mart = str(tmp_path / "mart")
    one = spark.createDataFrame([("d", "i", "uniform", 1, 2.0)], "dataset string, init_set string, cost_type string, budget int, a_r2 double")
    two = spark.createDataFrame([("d", "i", "region", 1, 3.0)], "dataset string, init_set string, cost_type string, budget int, b_r2 double")
    for own in (one, two, one):
        sources.write_results(own, mart)
    got = {(r["cost_type"], r["a_r2"], r["b_r2"]) for r in sources.combined_results(spark, mart).collect()}
    assert got == {("uniform", 2.0, None), ("region", None, 3.0)}


def test_required_columns_and_survey_labels(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1000)], "y double")
    with pytest.raises(ValueError, match="z"):
        prep.require_columns(df, "y", "z")
    got = sorted(r["y"] for r in prep.transformed(df.withColumn("y", 2015 - F.col("y")), "y", "B25035", logged=False).collect())
    assert got == [float(v) for v in range(999)]
    assert prep.transformed(df, "y", "B25001").agg(F.max("y")).first()[0] == pytest.approx(math.log(999))


@pytest.mark.parametrize("working, steps", [(4096, 6), (40, 200)])
def test_diversity_solves_a_bounded_set_of_units_together(spark, monkeypatch, working, steps):
    """1,500 units, labelled and vectorless ones among them: few steps where the best units fit into a task, and the same gap where they do not."""
    monkeypatch.setattr(inclusion, "WORKING", working, raising=False)
    n = 1500 if working > 1000 else 120
    x = np.random.default_rng(5).normal(size=(n, 16))
    df = spark.createDataFrame([(f"u{i}", str(i % 3), x[i].tolist()) for i in range(n) if i % 97], "unit string, grp string, x array<double>")
    units = spark.createDataFrame([(f"u{i}", 1.0 + i % 5, i % 211 == 5) for i in range(n)], "unit string, cost double, is_labeled boolean")
    blocks = inclusion.CosineBlocks(df)
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        got = inclusion.diversity_probabilities(units, blocks, 40.0, steps=steps)
    proof = inclusion.diversity_certificate(units, got, blocks, 40.0).first()
    assert proof["feasible"] and proof["gap_met"] and proof["n"] == n and (working == 40 or proof["spent"] == pytest.approx(40.0))
