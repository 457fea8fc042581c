"""Queries: ridge models and image features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import features, prep, ridge
from ..stored import stored
from . import fixtures as fx

LAMBDAS = (0.01, 1.0, 100.0)


def _rounded(*names, digits=6):
    return [F.bround(n, digits).alias(n) for n in names]


def stats(spark, d):
    """The sums of a run and fold, as (run_id, fold, i, j, value) of z = (1, x, y)."""
    got = ridge.sufficient_stats(fx.ridge_rows(spark, d))

    def cells(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                g = np.frombuffer(r["part"]).reshape(min(r["tile"], r["width"] - r["i"] * r["tile"]), -1)
                for (i, j), v in np.ndenumerate(g):
                    at = (r["i"] * r["tile"] + i, r["j"] * r["tile"] + j)
                    rows += [(r["run_id"], r["fold"], *p, float(v)) for p in {at, at[::-1] if r["i"] < r["j"] else at}]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["run_id", "fold", "i", "j", "value"])

    return got.mapInArrow(cells, "run_id string, fold int, i int, j int, value double")


def folds(spark, d):
    return ridge.with_folds(fx.ridge_rows(spark, d).select("id", "run_id"), 5, "cv")


def cv(spark, d):
    got = ridge.ridge_cv(ridge.sufficient_stats(fx.ridge_rows(spark, d)))
    return got.select("run_id", "n", F.bround("alpha", 9).alias("alpha"), F.bround("cv_r2", 6).alias("cv_r2"), F.bround("intercept", 5).alias("intercept"), *[F.bround(F.col("coef")[i], 6).alias(f"w{i + 1}") for i in range(3)])


def predictions(spark, d):
    rows = fx.ridge_rows(spark, d)
    models = spark.createDataFrame([("A", 20.0, [3.0, -2.0, 5.0]), ("N", 10.0, [2.0, 0.0, 5.0])], "run_id string, intercept double, coef array<double>")
    return ridge.ridge_predict(rows, models, ["run_id"], 25.0, 150.0).select("id", "pred")


def sweep(spark, d):
    own = fx.ridge_rows(spark, d).withColumns({"y": F.col("y"), "y2": F.col("x")[0] + F.col("x")[1]})
    return ridge.kfold_sweep(own, LAMBDAS, ("y", "y2"), bounds={"y": (0.0, 160.0)}).select("run_id", "fold", "outcome", "lambda", "ill", *_rounded("r2", "mse", "rmse", "mae"))


def single(spark, d):
    rows = fx.ridge_rows(spark, d)
    return ridge.single_solve(rows.filter("fold > 0"), rows.filter("fold = 0"), LAMBDAS).select("lambda", *_rounded("r2", "mse", "rmse", "mae"))


def best(spark, d):
    metrics = ridge.kfold_sweep(fx.ridge_rows(spark, d), LAMBDAS)
    return ridge.best_fold_results(metrics, ridge.best_hyperparameter(metrics)).select("run_id", "fold", "lambda", *_rounded("r2"))


def _best_models(spark, d):
    rows = fx.ridge_rows(spark, d)
    models = stored(ridge.ridge_sweep(ridge.sufficient_stats(rows), LAMBDAS), "models")
    return rows, models, ridge.best_hyperparameter(models)


def best_weights(spark, d):
    _, models, top = _best_models(spark, d)
    got = ridge.best_fold_results(models, top)
    return got.select("run_id", "fold", "lambda", F.bround("intercept", 5).alias("intercept"), *[F.bround(F.col("coef")[i], 6).alias(f"w{i + 1}") for i in range(3)])


def best_predictions(spark, d):
    return ridge.best_fold_predictions(*_best_models(spark, d)).select("run_id", "fold", "id", "lambda", *_rounded("pred", digits=5))


def chosen(spark, d):
    """Best lambda from metrics that a formula gives, so that SQL can follow."""
    rows = fx.ridge_rows(spark, d).select("run_id", "fold").distinct()
    grid = rows.withColumn("lambda", F.explode(F.array(*[F.lit(x) for x in (0.1, 1.0, 10.0, 100.0)]))).withColumn("outcome", F.lit("y"))
    r2 = 1 - F.abs(F.log10("lambda") - F.when(F.col("run_id") == "A", 1.0).otherwise(0.0)) / 10 - F.col("fold") / 100
    return ridge.best_hyperparameter(grid.withColumns({"r2": r2, "ill": (F.col("lambda") < 1) & (F.col("fold") == 3)})).select("run_id", "outcome", "lambda", F.bround("score", 9).alias("score"), "at_edge", "tied")


def regional(spark, d):
    rows = fx.ridge_rows(spark, d).drop("fold").withColumnRenamed("run_id", "region")
    return ridge.regional_cv(rows, LAMBDAS).select("run_id", "lambda", *_rounded("score"))


def guarded(spark, d):
    own = fx.points(spark, d).select(F.col("unit").alias("run_id"), "id")
    return ridge.min_sample_guard(own, 12)


def samples(spark, d):
    rows = fx.ridge_rows(spark, d)
    population = rows.select("id", "x", "y", F.when(F.col("fold") == 0, "test").otherwise("train").alias("split"))
    own = rows.filter("fold > 0").select(F.explode(F.array(F.lit("all"), F.concat(F.lit("flag_"), "run_id"))).alias("run_id"), "id")
    return ridge.score_samples(own, population).select("run_id", "n", F.bround("alpha", 9).alias("alpha"), *_rounded("r2", "mse", "rmse", "mae"))


def rounds(spark, d):
    rows = fx.ridge_rows(spark, d)
    population = rows.select("id", "x", "y", F.when(F.col("fold") == 0, "test").otherwise("train").alias("split"))
    status = rows.select("id", F.when((F.col("fold") == 1) & (F.col("run_id") == "A"), "labeled").otherwise("unlabeled").alias("status"))
    got = ridge.evaluate_round(population, status, rows.filter("fold = 2 and run_id = 'R'").select("id"))
    return got.select("run_id", "n", F.bround("alpha", 9).alias("alpha"), *_rounded("r2", "mse", "rmse", "mae"))


def bounded(spark, d):
    rows = fx.ridge_rows(spark, d)
    return ridge.bounded_ridge(rows.filter("fold > 0"), rows.filter("fold = 0"), 1.0, 10.0, 150.0).select("id", *_rounded("pred"))


def scene(spark, d):
    rows = fx.ridge_rows(spark, d).withColumn("y2", F.col("x")[0] - F.col("x")[2])
    return ridge.scene_regression(rows.filter("fold > 0"), rows.filter("fold = 0"), ["y", "y2"], 0.1, {"y": (0.0, None)}).select("id", "outcome", (F.bround("pred", 6) + 0.0).alias("pred"))


def prepared(spark, d):
    c = fx.table(spark, d, "customer")
    lab = c.select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 10 == 3, -999.0).otherwise(F.col("c_acctbal").cast("double") + 1000).alias("y"))
    feat = fx.geo(spark, d).select("id", F.array("lon", "lat").alias("x"), "lon", "lat").filter("nation <> 4")
    return prep.prepare_dataset(lab, feat, "population", "prep").select("id", F.bround("y", 9).alias("y"), "split")


def lambda_grid(spark, d):
    used = fx.table(spark, d, "customer").select("c_name", F.explode(F.array(*[F.lit(x) for x in ("roads", "income")])).alias("label"))
    return used.join(labels.lambda_grid(spark, "roads").withColumn("label", F.lit("roads")), "label").groupBy("lambda").agg(F.count("*").alias("n")).select(F.bround("lambda", 9).alias("lambda"), "n")


def tail(spark, d):
    return fx.features(spark, d).select("id", F.bround(F.aggregate(features.scale_tail_features(F.transform("x", lambda v: v.cast("double")), 4, 9.0), F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


def conv(spark, d):
    images = fx.features(spark, d).select("id", "x")
    got = features.random_conv_features(images, features.noise_filters(6, 3, 1, 5), 0.1, 8, 1, pool=3)
    return got.select("id", F.posexplode(F.transform("x", lambda v: v.cast("double"))).alias("k", "v"))


def patches(spark, d):
    return features.random_patches(fx.features(spark, d).select("id", "x"), 40, 3, 8, 1, "patch").select("id", "pos", F.bround(F.aggregate("p", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


def patch_features(spark, d):
    images = fx.features(spark, d).select("id", "x")
    return features.random_conv_features(images, features.patch_filters(images, 8, 3, 8, 1, "patch"), 0.05, 8, 1)


def pixel_model(spark, d):
    filters = features.noise_filters(4, 3, 1, 5)
    return features.pixel_predictions(fx.features(spark, d).select("id", "x"), filters, np.linspace(-1, 1, 8), 0.5, 0.1, 8, 1).withColumn("pred", F.bround("pred", 9))


# ridge in SQL: sums of three features, and the normal equations by Cramer's rule
SUMS = "count(*)::DOUBLE AS n, " + ", ".join(f"sum({a}) AS s{i}" for i, a in enumerate(("q", "dis", "tax"), 1)) + ", " + ", ".join(
    f"sum({a} * {b}) AS s{i}{j}" for i, a in enumerate(("q", "dis", "tax"), 1) for j, b in enumerate(("q", "dis", "tax"), 1) if i <= j
)
OF_Y = "sum({y}) AS sy, sum({y} * {y}) AS syy, " + ", ".join(f"sum({a} * {{y}}) AS s{i}y" for i, a in enumerate(("q", "dis", "tax"), 1))


def sums_sql(y: str = "y") -> str:
    return f"{SUMS}, {OF_Y.format(y=y)}"


def fit_sql(table: str, keys: str, lam: str, intercept: bool = True, standard: bool = False) -> str:
    """SELECT of keys, w1..w3 and b from a table with the sums and the penalty lam."""
    c = "1" if intercept else "0"
    scale = [f"sqrt((s{i}{i} - s{i} * s{i} / n) / n)" if standard else "1" for i in (1, 2, 3)]
    a = {(i, j): f"((s{i}{j} - {c} * s{i} * s{j} / n) / ({scale[i - 1]} * {scale[j - 1]}))" + (f" + {lam}" if i == j else "") for i in (1, 2, 3) for j in (1, 2, 3) if i <= j}
    cells = ", ".join(f"{v} AS a{i}{j}" for (i, j), v in a.items()) + ", " + ", ".join(f"(s{i}y - {c} * s{i} * sy / n) / {scale[i - 1]} AS c{i}, {scale[i - 1]} AS z{i}" for i in (1, 2, 3))
    w1 = "(c1 * (a22 * a33 - a23 * a23) - a12 * (c2 * a33 - a23 * c3) + a13 * (c2 * a23 - a22 * c3)) / det / z1"
    w2 = "(a11 * (c2 * a33 - a23 * c3) - c1 * (a12 * a33 - a23 * a13) + a13 * (a12 * c3 - c2 * a13)) / det / z2"
    w3 = "(a11 * (a22 * c3 - c2 * a23) - a12 * (a12 * c3 - c2 * a13) + c1 * (a12 * a23 - a22 * a13)) / det / z3"
    det = "a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13)"
    solved = f"SELECT *, {w1} AS w1, {w2} AS w2, {w3} AS w3 FROM (SELECT *, {det} AS det FROM (SELECT *, {cells} FROM {table}))"
    return f"SELECT {keys}, w1, w2, w3, {c} * (sy - w1 * s1 - w2 * s2 - w3 * s3) / n AS b FROM ({solved})"


R2 = "1 - (syy - 2 * (b * sy + w1 * s1y + w2 * s2y + w3 * s3y) + n * b * b + 2 * b * (w1 * s1 + w2 * s2 + w3 * s3) + w1 * w1 * s11 + w2 * w2 * s22 + w3 * w3 * s33 + 2 * (w1 * w2 * s12 + w1 * w3 * s13 + w2 * w3 * s23)) / (syy - sy * sy / n)"
NAMES = ["n", "s1", "s2", "s3", "s11", "s12", "s13", "s22", "s23", "s33", "sy", "syy", "s1y", "s2y", "s3y"]
PREDICTED = "b + w1 * q + w2 * dis + w3 * tax"
METRICS = "round_even(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round_even(avg((y - p) * (y - p)), 6) AS mse, round_even(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round_even(avg(abs(y - p)), 6) AS mae"
GRID = "(VALUES " + ", ".join(f"({x}::DOUBLE)" for x in LAMBDAS) + ") g(lam)"
ALPHA_GRID = "(VALUES " + ", ".join(f"({x!r}::DOUBLE)" for x in ridge.ALPHAS) + ") g(lam)"


def without_fold(table: str, keys: str) -> str:
    """Sums of all folds but one, for each."""
    return f"SELECT {keys}, fold, " + ", ".join(f"sum({c}) OVER (PARTITION BY {keys}) - {c} AS {c}" for c in NAMES) + f" FROM {table}"


def sweep_sql(rows: str, lo: str = "'-inf'::DOUBLE", hi: str = "'inf'::DOUBLE") -> str:
    """CTEs from rows (run_id, outcome, fold, q, dis, tax, y): metrics of every fold and lambda."""
    return f"""fs AS (SELECT run_id, outcome, fold, {sums_sql()} FROM {rows} GROUP BY ALL), loo AS ({without_fold('fs', 'run_id, outcome')}),
lg AS (SELECT * FROM loo, {GRID}), fitted AS ({fit_sql('lg', 'run_id, outcome, fold, lam', 'lam')}),
predicted AS (SELECT r.*, lam, least({hi}, greatest({lo}, {PREDICTED})) AS p FROM {rows} r JOIN fitted f ON r.run_id = f.run_id AND r.outcome = f.outcome AND r.fold = f.fold),
metrics AS (SELECT run_id, outcome, fold, lam, {METRICS}, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS raw FROM predicted GROUP BY ALL)"""


def cv_sql(rows: str) -> str:
    """CTEs from rows (run_id, fold, q, dis, tax, y): best (run_id, n, alpha, cv_r2, w1..w3, b) by cross-validation on standardised columns."""
    return f"""cs AS (SELECT run_id, fold, {sums_sql()} FROM {rows} GROUP BY ALL), cl AS (SELECT * FROM ({without_fold('cs', 'run_id')}), {ALPHA_GRID}),
cf AS ({fit_sql('cl', 'run_id, fold, lam', 'lam', standard=True)}), cr AS (SELECT cf.run_id, lam, avg({R2}) AS r2 FROM cf JOIN cs ON cf.run_id = cs.run_id AND cf.fold = cs.fold GROUP BY ALL),
cb AS (SELECT run_id, max(r2) AS cv_r2, arg_min(lam, (-r2, lam)) AS lam FROM cr GROUP BY run_id), ct AS (SELECT run_id, {", ".join(f"sum({c}) AS {c}" for c in NAMES)} FROM cs GROUP BY run_id),
ca AS (SELECT ct.*, cv_r2, lam FROM ct JOIN cb ON ct.run_id = cb.run_id), best AS ({fit_sql('ca', 'run_id, n::BIGINT AS n, lam AS alpha, cv_r2', 'lam', standard=True)})"""


def ranked_sql(seed: str, name: str) -> str:
    return f"row_number() OVER (PARTITION BY run_id ORDER BY substr(md5('{seed}|' || {name}), 1, 13), {name}) - 1"


SCORED = f"""test AS (SELECT * FROM ridge_y WHERE fold = 0), folded AS (SELECT * EXCLUDE fold, {ranked_sql('cv', "run_id || '|' || id")} AS k, (k % 5)::INT AS fold FROM chosen), {cv_sql('folded')},
scored AS (SELECT best.run_id, n, alpha, y, {PREDICTED} AS p FROM test, best)
SELECT run_id, any_value(n) AS n, round_even(any_value(alpha), 9) AS alpha, {METRICS} FROM scored GROUP BY run_id"""

def activations_sql(filters: np.ndarray, bias: float) -> str:
    """CTEs up to a (id, n, h, w, v): both activation maps of every 3 x 3 filter over the 8 x 8 embeddings."""
    values = ", ".join(f"({n}, [{', '.join(f'{float(v)!r}::DOUBLE' for v in f.ravel())}])" for n, f in enumerate(filters))
    return f"""px AS (SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS x FROM embeddings), f(n, f) AS (VALUES {values}),
c AS (SELECT id, n, h, w, list_sum(list_transform(range(9), lambda k: x[(h + k // 3) * 8 + w + k % 3 + 1] * f[k + 1])) AS c FROM px, f, range(6) y(h), range(6) z(w)),
a AS (SELECT id, n, h, w, greatest(c - {bias}, 0) AS v FROM c UNION ALL SELECT id, n + {len(filters)}, h, w, greatest(-c - {bias}, 0) FROM c)"""


_Z = ["1.0::DOUBLE", "q", "dis", "tax", "y"]
#: The lambda that each run's mean r2 over folds chooses.
CHOSEN = f"""WITH {fx.RIDGE}, long AS (SELECT *, 'y' AS outcome FROM ridge_y), {sweep_sql('long')}, m AS (SELECT run_id, lam, avg(raw) AS score FROM metrics GROUP BY ALL),
c AS (SELECT run_id, arg_min(lam, (-score, lam)) AS lam FROM m GROUP BY run_id)"""
QUERIES = {
    "ridge_sufficient_stats": stats, "ridge_folds": folds, "ridge_cv": cv, "ridge_predict": predictions, "kfold_sweep": sweep, "single_solve": single, "best_fold_results": best, "best_fold_weights": best_weights, "best_fold_predictions": best_predictions, "best_hyperparameter": chosen,
    "regional_cv": regional, "min_sample_guard": guarded, "score_samples": samples, "evaluate_round": rounds, "bounded_ridge": bounded, "scene_regression": scene, "prepare_dataset": prepared,
    "lambda_grid": lambda_grid, "scale_tail_features": tail, "random_conv_features": conv, "random_patches": patches, "patch_filter_features": patch_features, "pixel_predictions": pixel_model,
}
ORACLE_SQL = {
    "ridge_sufficient_stats": f"WITH {fx.RIDGE} " + " UNION ALL ".join(f"SELECT run_id, fold, {i}::INT AS i, {j}::INT AS j, sum({a} * {b}) AS value FROM ridge_y GROUP BY run_id, fold" for i, a in enumerate(_Z) for j, b in enumerate(_Z)),
    "ridge_folds": f"WITH {fx.RIDGE} SELECT id, run_id, ((row_number() OVER (PARTITION BY run_id ORDER BY substr(md5('cv|' || id), 1, 13), id) - 1) % 5)::INT AS fold FROM ridge",
    "ridge_cv": f"WITH {fx.RIDGE}, {cv_sql('ridge_y')} SELECT run_id, n, round_even(alpha, 9) AS alpha, round_even(cv_r2, 6) AS cv_r2, round_even(b, 5) AS intercept, round_even(w1, 6) AS w1, round_even(w2, 6) AS w2, round_even(w3, 6) AS w3 FROM best",
    "kfold_sweep": f"""WITH {fx.RIDGE}, long AS (SELECT * EXCLUDE y, y, 'y' AS outcome FROM ridge_y UNION ALL SELECT * EXCLUDE y, q + dis, 'y2' FROM ridge_y),
{sweep_sql('long', "CASE WHEN r.outcome = 'y' THEN 0.0 ELSE '-inf'::DOUBLE END", "CASE WHEN r.outcome = 'y' THEN 160.0 ELSE 'inf'::DOUBLE END")} SELECT run_id, fold, outcome, lam AS "lambda", false AS ill, r2, mse, rmse, mae FROM metrics""",
    "single_solve": f"""WITH {fx.RIDGE}, t AS (SELECT {sums_sql()} FROM ridge_y WHERE fold > 0), tg AS (SELECT * FROM t, {GRID}), f AS ({fit_sql('tg', 'lam', 'lam')})
SELECT lam AS lambda, {METRICS} FROM (SELECT lam, y, {PREDICTED} AS p FROM ridge_y, f WHERE fold = 0) GROUP BY lam""",
    "best_fold_results": f"""WITH {fx.RIDGE}, long AS (SELECT *, 'y' AS outcome FROM ridge_y), {sweep_sql('long')}, m AS (SELECT run_id, lam, avg(raw) AS score FROM metrics GROUP BY ALL),
b AS (SELECT run_id, arg_min(lam, (-score, lam)) AS lam FROM m GROUP BY run_id) SELECT metrics.run_id, fold, metrics.lam AS "lambda", r2 FROM metrics JOIN b ON metrics.run_id = b.run_id AND metrics.lam = b.lam""",
    "best_fold_weights": f"""{CHOSEN} SELECT f.run_id, fold, f.lam AS "lambda", round_even(f.b, 5) AS intercept, round_even(w1, 6) AS w1, round_even(w2, 6) AS w2, round_even(w3, 6) AS w3 FROM fitted f JOIN c ON f.run_id = c.run_id AND f.lam = c.lam""",
    "best_fold_predictions": f"""{CHOSEN} SELECT p.run_id, fold, id, p.lam AS "lambda", round_even(p, 5) AS pred FROM predicted p JOIN c ON p.run_id = c.run_id AND p.lam = c.lam""",
    "regional_cv": f"""WITH {fx.RIDGE}, ends AS (SELECT run_id, min(y) AS lo, max(y) AS hi FROM ridge_y GROUP BY run_id),
held AS (SELECT *, {ranked_sql('fold|test', 'id')} AS k, count(*) OVER (PARTITION BY run_id) AS c FROM ridge_y), kept AS (SELECT * EXCLUDE (k, c) FROM held WHERE k >= floor(c * 0.2::DOUBLE)),
long AS (SELECT kept.* EXCLUDE fold, {ranked_sql('fold', 'id').replace('run_id', 'kept.run_id')} AS k, (k % 5)::INT AS fold, 'y' AS outcome, lo, hi FROM kept JOIN ends ON kept.run_id = ends.run_id),
{sweep_sql('long', 'r.lo', 'r.hi')}, m AS (SELECT run_id, lam, avg(raw) AS score FROM metrics GROUP BY ALL)
SELECT run_id, arg_min(lam, (-score, lam)) AS "lambda", round_even(max(score), 6) AS score FROM m GROUP BY run_id""",
    "score_samples": f"WITH {fx.RIDGE}, chosen AS (SELECT * EXCLUDE run_id, unnest(['all', 'flag_' || run_id]) AS run_id FROM ridge_y WHERE fold > 0), {SCORED}",
    "evaluate_round": f"""WITH {fx.RIDGE}, chosen AS (SELECT * EXCLUDE run_id, 'initial' AS run_id FROM ridge_y WHERE fold = 1 AND run_id = 'A'
UNION ALL SELECT * EXCLUDE run_id, 'updated' FROM ridge_y WHERE (fold = 1 AND run_id = 'A') OR (fold = 2 AND run_id = 'R')), {SCORED}""",
    "bounded_ridge": f"""WITH {fx.RIDGE}, t AS (SELECT {sums_sql()}, 1.0::DOUBLE AS lam FROM ridge_y WHERE fold > 0), f AS ({fit_sql('t', 'lam', 'lam', intercept=False)})
SELECT id, round_even(least(150.0, greatest(10.0, {PREDICTED})), 6) AS pred FROM ridge_y, f WHERE fold = 0""",
    "scene_regression": f"""WITH {fx.RIDGE}, long AS (SELECT *, 'y' AS outcome FROM ridge_y UNION ALL SELECT * REPLACE (q - tax AS y), 'y2' FROM ridge_y),
t AS (SELECT outcome, {sums_sql()}, 0.1::DOUBLE AS lam FROM long WHERE fold > 0 GROUP BY outcome), f AS ({fit_sql('t', 'outcome', 'lam')})
SELECT id, f.outcome, round_even(CASE f.outcome WHEN 'y' THEN greatest(0.0, {PREDICTED}) ELSE {PREDICTED} END, 6) + 0.0::DOUBLE AS pred FROM long JOIN f ON long.outcome = f.outcome WHERE fold = 0""",  # + 0: a zero has no sign
    "random_conv_features": f"WITH {activations_sql(features.noise_filters(6, 3, 1, 5), 0.1)} SELECT id, (n * 4 + h // 3 * 2 + w // 3)::INT AS k, avg(v)::FLOAT::DOUBLE AS v FROM a GROUP BY ALL",
    "pixel_predictions": f"""WITH {activations_sql(features.noise_filters(4, 3, 1, 5), 0.1)}, weights(n, weight) AS (VALUES {", ".join(f"({n}, {float(w)!r}::DOUBLE)" for n, w in enumerate(np.linspace(-1, 1, 8)))})
SELECT id AS tile_id, h::INT AS row, w::INT AS col, round_even(0.5 + sum(weight * v), 9) AS pred FROM a JOIN weights ON a.n = weights.n GROUP BY ALL""",
    "ridge_predict": f"WITH {fx.RIDGE} SELECT id, least(150.0, greatest(25.0, CASE run_id WHEN 'A' THEN 20 + 3 * q - 2 * dis + 5 * tax ELSE 10 + 2 * q + 5 * tax END)) AS pred FROM ridge WHERE run_id IN ('A', 'N')",
    "best_hyperparameter": "SELECT DISTINCT l_returnflag AS run_id, 'y' AS outcome, CASE WHEN l_returnflag = 'A' THEN 10.0::DOUBLE ELSE 1.0 END AS lambda, 0.98::DOUBLE AS score, l_returnflag <> 'A' AS at_edge, false AS tied FROM lineitem",
    "min_sample_guard": f"WITH {fx.POINTS} SELECT unit AS run_id, id FROM points WHERE unit IN (SELECT unit FROM points GROUP BY unit HAVING count(*) >= 12)",
    "prepare_dataset": f"""WITH {fx.GEO}, p AS (SELECT id, ln(c_acctbal::DOUBLE + 1001) AS y FROM customer JOIN geo ON id = c_custkey::VARCHAR WHERE nation <> 4 AND c_custkey % 10 <> 3),
r AS (SELECT *, row_number() OVER (ORDER BY substr(md5('prep|' || id), 1, 13), id) - 1 AS k, count(*) OVER () AS n FROM p) SELECT id, round_even(y, 9) AS y, CASE WHEN k < floor(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM r""",
    "lambda_grid": "SELECT round_even(pow(10.0::DOUBLE, -3 + 6 * i / 8), 9) AS lambda, count(*) AS n FROM customer, range(9) t(i) GROUP BY i",
    "scale_tail_features": "SELECT vec_id::VARCHAR AS id, round_even(list_sum(list_transform(embedding::DOUBLE[], lambda v, i: CASE WHEN i > len(embedding) - 4 THEN v * 3 ELSE v END)), 6) AS total FROM embeddings",
    "random_patches": """WITH p AS (SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS x, unnest(range(36)) AS pos FROM embeddings),
c AS (SELECT * FROM p ORDER BY substr(md5('patch|' || id || '|' || pos), 1, 13), id, pos LIMIT 40)
SELECT id, pos::INT AS pos, round_even(list_sum(list_transform(range(9), lambda k: x[(pos // 6 + k // 3) * 8 + pos % 6 + k % 3 + 1])), 6) AS total FROM c""",
}
