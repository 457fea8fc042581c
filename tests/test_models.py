"""Ridge against numpy, features against direct loops, files against what was written."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplewright import sources
from samplewright.operators import aggregates, features, groups, prep, results, ridge, spatial
from samplewright.plans import QUERIES
from samplewright.plans import fixtures as fx
from samplewright.streaming import append_metrics, stream_run_logs


@pytest.fixture(scope="module")
def xy():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4)) * [1, 10, 0.1, 1] + [0, 100, 5, 0]
    x[:, 3] = 2.0  # a constant
    return x, x @ [1.0, 0.2, -3.0, 0.0] + rng.normal(size=120)


@pytest.fixture(scope="module")
def frame(spark, xy):
    x, y = xy
    return spark.createDataFrame([("r", str(i), i % 5, x[i].tolist(), float(y[i])) for i in range(len(y))], "run_id string, id string, fold int, x array<double>, y double")


def direct(x, y, a):
    mean, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1)
    z = (x - mean) / scale
    w = np.linalg.solve(z.T @ z + a * np.eye(z.shape[1]), z.T @ (y - y.mean())) / scale
    return y.mean() - mean @ w, w


@pytest.mark.parametrize("tile", [256, 2])
def test_ridge_cv_equals_direct_fits(frame, xy, tile):
    x, y = xy
    got, fold = ridge.ridge_cv(ridge.sufficient_stats(frame, tile=tile)).first(), np.arange(len(y)) % 5
    mean = []
    for a in ridge.ALPHAS:
        r2 = []
        for f in range(5):
            b, w = direct(x[fold != f], y[fold != f], a)
            e = y[fold == f] - x[fold == f] @ w - b
            r2.append(1 - (e @ e) / ((y[fold == f] - y[fold == f].mean()) ** 2).sum())
        mean.append(np.mean(r2))
    best = int(np.argmax(mean))
    assert got["alpha"] == ridge.ALPHAS[best] and np.isclose(got["cv_r2"], mean[best])
    b, w = direct(x, y, ridge.ALPHAS[best])
    assert np.allclose(got["coef"], w, atol=1e-6) and np.isclose(got["intercept"], b, atol=1e-4)


def test_wide_ridge_is_bounded_by_tiles_and_folds(spark):
    """1,000 features: tiles of at most TILE columns travel, and a task sees one fold of a run."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 1000)).round(3)
    y = x[:, :5].sum(axis=1) + rng.normal(size=400)
    df = spark.createDataFrame([("r", i % 4, x[i].tolist(), float(y[i])) for i in range(400)], "run_id string, fold int, x array<double>, y double").repartition(3)
    stats = ridge.sufficient_stats(df)
    sizes = [len(r["part"]) for r in stats.collect()]
    assert len(sizes) == 4 * 10 and max(sizes) <= 8 * ridge.TILE**2 and sum(sizes) < 4 * 8 * 1002 * (1002 + ridge.TILE) / 2 * 1.1
    model = ridge.ridge_cv(stats, (10.0, 1000.0))
    plan = model._jdf.queryExecution().executedPlan().toString()
    assert "run_id" in plan and plan.count("FlatMapGroupsInArrow") == 4  # two levels of sums, one left out, one solve
    got = model.first()
    b, w = direct(x, y, got["alpha"])
    assert np.allclose(got["coef"], w, atol=1e-8) and np.isclose(got["intercept"], b)
    scores = {}
    for a in (10.0, 1000.0):
        r2 = []
        for f in range(4):
            t = np.arange(400) % 4 == f
            c, v = direct(x[~t], y[~t], a)
            r2.append(1 - ((y[t] - x[t] @ v - c) ** 2).sum() / ((y[t] - y[t].mean()) ** 2).sum())
        scores[a] = np.mean(r2)
    assert got["alpha"] == max(scores, key=scores.get) and np.isclose(got["cv_r2"], max(scores.values()))


def test_sweep_without_intercept(frame, xy):
    x, y = xy
    got = ridge.ridge_sweep(ridge.sufficient_stats(frame), [2.0], intercept=False, leave_out=False).first()
    assert np.allclose(got["coef"], np.linalg.solve(x.T @ x + 2 * np.eye(4), x.T @ y), atol=1e-6) and got["intercept"] == 0


def test_small_runs_are_not_fitted(frame):
    assert ridge.ridge_cv(ridge.sufficient_stats(frame.filter("cast(id as int) < 4"))).count() == 0


def test_best_hyperparameter_needs_a_well_conditioned_lambda(spark):
    bad = spark.createDataFrame([("r", "y", 1.0, True, 0.5)], "run_id string, outcome string, lambda double, ill boolean, r2 double")
    with pytest.raises(Exception, match="well-conditioned"):
        ridge.best_hyperparameter(bad).collect()


def test_convolution_features_equal_loops(spark):
    rng = np.random.default_rng(0)
    image, filters = rng.normal(size=(2, 5, 5)), rng.normal(size=(3, 2, 3, 3))
    df = spark.createDataFrame([("a", [float(v) for v in image.ravel()])], "id string, x array<float>")
    got = features.random_conv_features(df, filters, 0.2, 5, 2).first()["x"]
    maps = np.array([[[(image[:, r : r + 3, c : c + 3] * f).sum() for c in range(3)] for r in range(3)] for f in filters])
    want = np.r_[np.maximum(maps - 0.2, 0).mean((1, 2)), np.maximum(-maps - 0.2, 0).mean((1, 2))]
    assert np.allclose(got, want, atol=1e-5)


def test_whitened_patches_have_unit_covariance():
    p = features.normed(np.random.default_rng(1).normal(size=(4000, 9)))
    mean = p.mean(axis=0)
    w = (p - mean) @ features.whitening(mean, p.T @ p / len(p), eps=1e-9)
    values = np.linalg.eigvalsh(np.cov(w.T))
    assert np.allclose(values[1:], 1, atol=0.1)  # the mean direction is gone


def test_class_shares_of_a_tile_without_expected_classes(spark):
    px = spark.createDataFrame([("a", 11), ("a", 11), ("a", 0), ("b", 99)], "tile_id string, class int")
    assert [r["tile_id"] for r in aggregates.class_shares(px).collect()] == ["a"]
    rows = {r["tile_id"]: r["c11"] for r in aggregates.class_shares(px, keep_empty=True).collect()}
    assert rows == {"a": 1.0, "b": 0.0}


def test_points_on_edges_and_in_holes(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
    poly = spark.createDataFrame([(7, [ring, hole])], "polygon int, rings array<array<struct<x double, y double>>>")
    pts = spark.createDataFrame([("in", 3.0, 3.0), ("edge", 4.0, 2.0), ("hole", 1.5, 1.5), ("out", 9.0, 9.0)], "id string, lon double, lat double")
    got = {r["id"]: r["polygon"] for r in spatial.points_within_polygons(pts, poly).collect()}
    assert got == {"in": 7, "edge": None, "hole": None, "out": None}
    assert {r["id"]: r["polygon"] for r in spatial.polygon_or_nearest(pts, poly).collect()} == dict.fromkeys(("in", "edge", "hole", "out"), 7)


def test_grid_recurrence(spark):
    lon, lat = spatial.make_grid(spark, 10, 640, 0.0, 10.0, 20.0, 30.0)
    lats = [r["coord"] for r in lat.orderBy("idx").collect()]
    step = lon.orderBy("idx").take(2)
    w = step[1]["coord"] - step[0]["coord"]
    assert all(np.isclose(a - b, w * np.cos(np.radians(a))) for a, b in zip(lats, lats[1:], strict=False)) and lats[-1] >= 20


def test_best_k_finds_separated_clusters(spark):
    rng = np.random.default_rng(2)
    rows = [(str(i), (rng.normal(size=2) + [20 * (i % 3), 0]).tolist()) for i in range(60)]
    assert groups.best_k(spark.createDataFrame(rows, "id string, x array<double>"), range(2, 6)) == 3


def test_status_rejects_unknown_and_overlapping_ids(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    with pytest.raises(ValueError):
        prep.make_status(ids, spark.createDataFrame([("z",)], "id string"))
    with pytest.raises(ValueError):
        prep.make_status(ids, ids.limit(1), ids)
    with pytest.raises(ValueError):
        prep.require_columns(ids, "y")


def test_optimised_run_paths(spark):
    paths = [
        ("/o/TOGO_PH_H2O/ridge/empty_initial_set/uniform/opt/poprisk/nlcd/budget_100/util_lambda_0.5/seed_3",),
        ("/o/TOGO_PH_H2O/ridge/cluster/set_50_size_seed_1/region/opt/greedycost/budget_20/seed_1",),
        ("/o/TOGO_PH_H2O/ridge/multiple/x/set_seed_4/region/random/budget_7/seed_4",),
        ("/o/OTHER/ridge/seed_1",),
    ]
    got = [tuple(r[0]) if r[0] else None for r in spark.createDataFrame(paths, "p string").select(results.parse_run_path(F.col("p"), ["TOGO_PH_H2O"])).collect()]
    assert got == [
        ("TOGO_PH_H2O", "empty_initial_set", "uniform", "poprisk_nlcd_0.5", "100", "3"),
        ("TOGO_PH_H2O", "set_50_size", "region", "greedycost", "20", "1"),
        ("TOGO_PH_H2O", "set", "region", "random", "7", "4"),
        None,
    ]


def test_logs_are_read_streamed_and_summarised(spark, tmp_path):
    for seed in range(3):
        own = tmp_path / f"TOGO_PH_H2O/ridge/c/set_50_size_seed_{seed}/uniform/random/budget_9/seed_{seed}"
        own.mkdir(parents=True)
        (own / "stdout.log").write_text(f"Initial R² score: 0.{seed}\nSampled 9 points.\nUpdated R² score: 0.5\nUpdated MSE: nan\n")
        (tmp_path / f"initial_set_metrics_seed_{seed}.json").write_text(json.dumps({"r2": seed / 10}) if seed else "{bad")
    runs = results.collect_runs(sources.read_run_logs(spark, str(tmp_path)), ["TOGO_PH_H2O"])
    assert {(r["seed"], r["initial_r2"], r["size"], r["updated_mse"]) for r in runs.collect()} == {(str(s), s / 10, 9.0, None) for s in range(3)}
    append_metrics(stream_run_logs(spark, str(tmp_path)), ["TOGO_PH_H2O"], str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    assert {(r["seed"], r["value"]) for r in sources.read_metric_json(spark, str(tmp_path)).collect()} == {("1", 0.1), ("2", 0.2)}


def test_label_files(spark, tmp_path):
    (tmp_path / "y.csv").write_text("ID,pop,lat,lon,extra\n1,2.5,1,2,x\n2,NA,1,2,y\n3,,1,2,z\n")
    got = {r["id"]: r["pop"] for r in sources.read_labels(spark, str(tmp_path / "y.csv"), ["pop"]).collect()}
    assert got == {"1": 2.5, "2": None, "3": None}
    with pytest.raises(ValueError):
        sources.read_labels(spark, str(tmp_path / "y.csv"), ["none"])
    (tmp_path / "ids.txt").write_text("a\n b \n\n")
    assert sorted(r["id"] for r in sources.read_split(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b"]
    sources.write_table(spark.createDataFrame([("r1", "a"), ("r2", "b")], "run_id string, id string"), str(tmp_path / "s"))
    assert [r["id"] for r in sources.read_sample(spark, str(tmp_path / "s"), "r2").collect()] == ["b"]


def test_sweep_r2_comes_from_the_sums(spark, data):
    """The r2 of ridge_sweep is that of the rows' predictions, for every outcome and in narrow tiles."""
    rows = fx.ridge_rows(spark, data).withColumns({"y2": F.col("x")[0] - F.col("y")})
    want = {(r["run_id"], r["fold"], r["outcome"], r["lambda"]): r["r2"] for r in ridge.kfold_sweep(rows, (0.01, 100.0), ("y", "y2")).collect()}
    for tile in (2, 4, 256):
        got = ridge.ridge_sweep(ridge.sufficient_stats(rows, ("y", "y2"), tile=tile), (0.01, 100.0), ("y", "y2")).collect()
        assert {(r["run_id"], r["fold"], r["outcome"], r["lambda"]): r["r2"] for r in got} == pytest.approx(want, abs=1e-9)


def test_samples_meet_the_population_once(spark, data, monkeypatch):
    """evaluate_round stores the rows that met, and again with their folds, before it adds them up."""
    names = []

    def kept(df, name, store=ridge.stored):
        names.append(name)
        return store(df, name)

    monkeypatch.setattr(ridge, "stored", kept)
    QUERIES["evaluate_round"](spark, data).collect()
    assert names[:2] == ["train", "folded"]


def test_scores_of_many_rows_keep_their_last_digits(spark):
    """Two penalties whose r2 differ by 1e-15 over two million rows are told apart: sums of the errors gather no rounding."""
    rows = spark.range(0, 2_000_000, 1, 2).select(F.floor(200 * F.rand(1)).alias("y"), F.rand(2).alias("u")).select(F.lit("r").alias("run_id"), F.col("y").cast("double").alias("y"), (F.col("y") + 30 * F.col("u") - 15).alias("pred")).repartition(2).cache()
    t = rows.select("y", "pred").toArrow()
    y, p = (t.column(c).to_numpy() for c in ("y", "pred"))
    sse, sst = math.fsum((y - p) ** 2), math.fsum((y - math.fsum(y) / len(y)) ** 2)
    got = aggregates.precise_metrics(rows, ["run_id"]).first()
    assert abs((1 - got["r2"]) - sse / sst) <= 1e-16
    assert got["mse"] == pytest.approx(sse / len(y), rel=1e-15) and got["mae"] == pytest.approx(math.fsum(abs(y - p)) / len(y), rel=1e-14)
    plain = aggregates.regression_metrics(rows, ["run_id"]).first()
    assert (got["r2"], got["rmse"]) == (pytest.approx(plain["r2"]), pytest.approx(plain["rmse"]))
    odd = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, 2.0), ("b", 1.0, None), ("c", 2.0, 2.5)], "run_id string, y double, pred double")
    got = {r["run_id"]: (r["r2"], r["mse"]) for r in aggregates.precise_metrics(odd, ["run_id"]).collect()}
    assert got == {"a": (0.5, 0.5), "b": (None, None), "c": (None, 0.25)}


#: Sums of (1, x, y) by itself of five folds of 60 copies of the line items' run A: upper triangles.
MANY = [
    [2387520, 61008000, 11910600, 9525180, 253341176, 2056321080, 303695280, 243420720, 7967093218, 79837080, 47426340, 1220515039, 51168900, 1076777183, 32097277936],
    [2419200, 61428000, 12079080, 9643200, 255504160, 2066579040, 306837540, 244442760, 8005477465, 80922960, 48090900, 1234543219, 51738120, 1083788901, 32268627430],
    [2408880, 61283760, 12061680, 9612060, 254718864, 2059768920, 307157160, 244306980, 7980390883, 80946480, 48077400, 1235004700, 51684540, 1082485298, 32166868444],
    [2377860, 60555300, 11854140, 9478980, 251765134, 2036888460, 302121240, 241014660, 7893558060, 79474620, 47200620, 1214804356, 50908020, 1068186899, 31823109732],
    [2397540, 61078020, 11983200, 9552480, 253784989, 2053817580, 304724460, 242963160, 7957938269, 80218680, 47689740, 1225878451, 51264600, 1076160207, 32071633591],
]


def test_penalties_whose_r2_are_equal_as_doubles_are_told_apart(spark):
    """The mean r2 of the two best penalties differ by 1e-17; the first wins in exact fractions."""
    from fractions import Fraction

    sums = []
    for own in MANY:
        g = [[0] * 5 for _ in range(5)]
        for v, (i, j) in zip(own, ((i, j) for i in range(5) for j in range(i, 5)), strict=True):
            g[i][j] = g[j][i] = v
        sums.append(g)

    def mean_r2(alpha):
        r2 = []
        for p in sums:
            g = [[Fraction(sum(s[i][j] for s in sums) - p[i][j]) for j in range(5)] for i in range(5)]
            n = g[0][0]
            c = [[g[i][j] - g[0][i] * g[0][j] / n for j in range(1, 5)] for i in range(1, 4)]
            for i in range(3):
                c[i][i] += Fraction(alpha) * c[i][i] / n
            for i in range(3):
                c[i] = [v / c[i][i] for v in c[i]]
                for k in {0, 1, 2} - {i}:
                    c[k] = [a - c[k][i] * b for a, b in zip(c[k], c[i], strict=True)]
            w = [c[i][3] for i in range(3)]
            v = [(g[0][4] - sum(a * b for a, b in zip(w, g[0][1:4], strict=True))) / n, *w, Fraction(-1)]
            sse = sum(v[i] * v[j] * p[i][j] for i in range(5) for j in range(5))
            r2.append(1 - sse / (p[4][4] - Fraction(p[0][4]) ** 2 / p[0][0]))
        return sum(r2) / len(r2)

    exact = {a: mean_r2(a) for a in ridge.ALPHAS}
    first, second = sorted(exact, key=exact.get, reverse=True)[:2]
    assert 0 < exact[first] - exact[second] < 2e-17
    stats = spark.createDataFrame([("A", f, 0, 0, 5, 256, np.array(g, float).tobytes()) for f, g in enumerate(sums)], ridge.STATS)
    got = ridge.ridge_cv(stats).first()
    assert got["alpha"] == first and got["cv_r2"] == pytest.approx(float(exact[first]), abs=1e-15)


def test_best_lambda_is_chosen_by_what_is_unexplained(spark):
    """0.06 has digits that 1 - 0.06 has not."""
    lost = {1.0: (0.0625, 0.0625), 10.0: (0.0625 - 2**-57, 0.0625 - 2**-57)}
    rows = [("r", f, "y", lam, False, 1 - v, v) for lam, of in lost.items() for f, v in enumerate(of)]
    metrics = spark.createDataFrame(rows, "run_id string, fold int, outcome string, lambda double, ill boolean, r2 double, unexplained double")
    got = ridge.best_hyperparameter(metrics).first()
    assert (got["lambda"], got["tied"], got["score"]) == (10.0, False, 0.9375)
    assert ridge.best_hyperparameter(metrics.drop("unexplained")).first()["lambda"] == 1.0


def test_samples_are_dealt_in_slices_that_leave_no_shuffle_files(spark, data, monkeypatch):
    """Scores do not depend on the number of slices; each slice is stored before the next is shuffled, and its shuffle files go."""
    names, left, tracker = [], [], spark.sparkContext._jsc.sc().env().mapOutputTracker()

    def kept(df, name, store=ridge.stored):
        names.append(name)
        out = store(df, name)
        left.append(tracker.shuffleStatuses().size())
        return out

    whole = QUERIES["score_samples"](spark, data).collect()
    monkeypatch.setattr(ridge, "SLICE_ROWS", 3000)
    monkeypatch.setattr(ridge, "stored", kept)
    before = tracker.shuffleStatuses().size()
    got = QUERIES["score_samples"](spark, data).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole))
    many = names.count("train")
    assert many > 2 and names[: 2 * many] == ["train"] * many + ["folded"] * many
    assert max(left[:many]) <= before + 4  # the count of the samples alone, not a shuffle for each slice
