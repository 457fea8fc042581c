"""Ridge regression from sufficient statistics.

Rows are read once: every partition adds up, for each run and fold, the products
of (1, x, y) with itself, in tiles of TILE columns. All folds, penalties and
refits are solved from those sums, a task for each run and fold, so a sweep over
many samples is one job.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import clip as clipped
from ..prefix import hash_ranked, hash_ranked_in_slices
from ..stored import erase_since, stored, stored_so_far
from .aggregates import metric_columns, precise_metrics

ALPHAS = tuple(float(a) for a in np.logspace(-5, 5, 10))
#: Columns of a tile of a Gram matrix, and bytes of the sums that a task holds before it sends them on.
TILE, HELD_BYTES = 256, 1 << 28
#: Parts in which the sums of all tasks are added first.
SALTS = 32
#: Rows of samples that are dealt at once.
SLICE_ROWS = 1 << 25
#: Bytes of models that are sent to all tasks at once, about.
MODEL_BYTES = 1 << 26


def with_folds(df: DataFrame, k: int, seed: str, by: Sequence[str] = ("run_id",), id_col: str = "id") -> DataFrame:
    """Adds fold: the place in a random order of the run, modulo k."""
    return hash_ranked(df, seed, id_col, by=list(by)).withColumn("fold", (F.col("rank") % k).cast("int")).drop("rank")


def tiles(width: int, tile: int = TILE) -> list[tuple[int, int]]:
    """The tiles (i, j), i <= j, of a symmetric matrix: the others are their mirror images."""
    n = -(-width // tile)
    return [(i, j) for i in range(n) for j in range(i, n)]


def _span(i: int, width: int, tile: int) -> slice:
    return slice(i * tile, min((i + 1) * tile, width))


def matrix_of(width: int, tile: int, parts: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    """The whole matrix from its tiles."""
    g = np.empty((width, width))
    for (i, j), p in parts.items():
        rows, cols = _span(i, width, tile), _span(j, width, tile)
        g[rows, cols] = p.reshape(rows.stop - rows.start, -1)
        g[cols, rows] = g[rows, cols].T
    return g


STATS = "run_id string, fold int, i int, j int, width int, tile int, part binary"


def sufficient_stats(df: DataFrame, y: Sequence[str] = ("y",), x: str = "x", tile: int = TILE) -> DataFrame:
    """(run_id, fold, i, j, width, tile, part): tiles of the sum of z z' with z = (1, x, y...), from (run_id, fold, x, y...).

    Rows with a null in x or y are left out. Every task adds up the rows of a run
    and fold before it sends tiles on; it holds HELD_BYTES of sums at most: where few
    sums fit, its rows are sorted by run and fold first; where not even one does,
    its tiles are dealt to several passes over the rows. Sums of many tasks are
    added in two levels, tile by tile as they arrive.
    """
    ys = list(y)
    ok = F.col(x).isNotNull() & F.forall(x, lambda v: v.isNotNull())
    for c in ys:
        ok = ok & F.col(c).isNotNull()
    own = df.filter(ok).select("run_id", F.col("fold").cast("int").alias("fold"), F.col(x).cast("array<double>").alias("x"), F.array(*[F.col(c).cast("double") for c in ys]).alias("y"))
    one = own.select(F.size("x").alias("d")).first()
    width = 1 + len(ys) + (one["d"] if one else 0)
    every, at_once = tiles(width, tile), max(1, HELD_BYTES // (8 * min(tile, width) ** 2))
    held = max(1, at_once // len(every))
    if held < 64:
        own = own.sortWithinPartitions("run_id", "fold")
    names = ["run_id", "fold", "i", "j", "width", "tile", "part"]

    def batches_of(sums: dict) -> Iterator[pa.RecordBatch]:
        for (r, f), parts in sums.items():
            for (i, j), p in parts.items():
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.string()), *(pa.array([v], pa.int32()) for v in (f, i, j, width, tile)), pa.array([p.tobytes()], pa.binary())], names)

    def adds(own_tiles: list[tuple[int, int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict = {}
            for b in batches:
                n = b.num_rows
                if not n:
                    continue
                z = np.column_stack([np.ones(n), *(c.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in (b.column("x"), b.column("y")))])
                where: dict = {}
                for k, key in enumerate(zip(b.column("run_id").to_pylist(), b.column("fold").to_pylist(), strict=True)):
                    where.setdefault(key, []).append(k)
                for key, rows in where.items():
                    if key not in sums and len(sums) >= held:
                        yield from batches_of(sums)
                        sums = {}
                    part, mine = z[rows], sums.setdefault(key, {})
                    for i, j in own_tiles:
                        mine[i, j] = mine.get((i, j), 0) + part[:, _span(i, width, tile)].T @ part[:, _span(j, width, tile)]
            yield from batches_of(sums)

        return run

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = 0, None
        for b in batches:
            first = b.slice(0, 1) if first is None and b.num_rows else first
            for p in b.column("part"):
                total = total + np.frombuffer(p.as_buffer())
        yield pa.RecordBatch.from_arrays([*(first.column(c) for c in names[:-1]), pa.array([total.tobytes()], pa.binary())], names)

    by = ["run_id", "fold", "i", "j"]
    passes = [own.mapInArrow(adds(every[k : k + at_once]), STATS) for k in range(0, len(every), at_once)]
    salted = reduce(DataFrame.unionByName, passes).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    return salted.groupBy(*by, "salt").applyInArrow(add, STATS).groupBy(*by).applyInArrow(add, STATS)


def left_out(stats: DataFrame) -> DataFrame:
    """(run_id, fold, i, j, width, tile, folds, train, part): tiles of every fold's own sum and of the sum of its run's other
    folds; and fold -1, without a part, whose train is the sum of all. A task sees one tile of the folds of a run."""
    names = ["run_id", "fold", "i", "j", "width", "tile", "folds", "train", "part"]

    def run(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(p.as_buffer()) for p in t.column("part")]
        total, k = sum(parts), len(parts)
        fixed = [pa.array([t.column(c)[0].as_py()] * (k + 1), pa.int32()) for c in ("i", "j", "width", "tile")]
        cols = [pa.array([t.column("run_id")[0].as_py()] * (k + 1), pa.string()), pa.array([*t.column("fold").to_pylist(), -1], pa.int32()), *fixed, pa.array([k] * (k + 1), pa.int32())]
        return pa.table([*cols, pa.array([*((total - p).tobytes() for p in parts), total.tobytes()], pa.binary()), pa.array([*(p.tobytes() for p in parts), None], pa.binary())], names)

    return stats.groupBy("run_id", "i", "j").applyInArrow(run, "run_id string, fold int, i int, j int, width int, tile int, folds int, train binary, part binary")


def _read_tiles(t: pa.Table, column: str) -> dict[tuple[int, int], np.ndarray]:
    keys = zip(t.column("i").to_pylist(), t.column("j").to_pylist(), t.column(column), strict=True)
    return {(i, j): np.frombuffer(p.as_buffer()) for i, j, p in keys if p.is_valid}


def _standard(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Centred and scaled x'x, x'y, means and scales (population deviation, 1 for constants), and y's mean."""
    n, d = g[0, 0], len(g) - 2
    mean = g[0, 1 : d + 1] / n
    cov = g[1 : d + 1, 1 : d + 1] / n - np.outer(mean, mean)
    var = np.diag(cov).copy()
    scale = np.where(var > 1e-12 * np.maximum(1, mean**2), np.sqrt(np.maximum(var, 0)), 1.0)
    y_mean = g[0, d + 1] / n
    xy = (g[1 : d + 1, d + 1] / n - mean * y_mean) / scale
    return n * cov / np.outer(scale, scale), n * xy, mean, scale, y_mean


def fit_alphas(g: np.ndarray, alphas: Sequence[float]) -> list[tuple[float, np.ndarray]]:
    """(intercept, coefficients) for each alpha: ridge on standardised columns, the intercept unpenalised."""
    xx, xy, mean, scale, y_mean = _standard(g)
    values, vectors = np.linalg.eigh(xx)
    out = []
    for a in alphas:
        w = vectors @ ((vectors.T @ xy) / (np.maximum(values, 0) + a)) / scale
        out.append((y_mean - mean @ w, w))
    return out


def _unexplained(width: int, tile: int, parts: dict[tuple[int, int], np.ndarray], v: np.ndarray, y: int | None = None) -> np.ndarray:
    """1 - r2 of linear models, columns (intercept, coefficients, -1) of v, on the rows that a fold's tiles sum up; NaN when y does not vary.

    y is the outcome's place where there are several: v has -1 there and 0 at the others.
    The sums are centred, and added up in long doubles: models of millions of rows differ by less than a double's last digit of r2.
    """
    y, wide = width - 1 if y is None else y, np.longdouble
    v, n = v.astype(wide), wide(parts[0, 0][0])
    sums = np.concatenate([parts[0, j].reshape(-1, min(tile, width - j * tile))[0] for j in range(-(-width // tile))]).astype(wide)
    sse, sst = (sums @ v) ** 2 / n, wide(np.nan)
    for (i, j), p in parts.items():
        rows, cols = _span(i, width, tile), _span(j, width, tile)
        apart = p.reshape(rows.stop - rows.start, -1) - np.outer(sums[rows], sums[cols]) / n
        sse += (1 if i == j else 2) * (v[rows] * (apart @ v[cols])).sum(axis=0)
        if i == j == y // tile:
            sst = apart[y - rows.start, y - rows.start]
    return sse / sst if sst > 0 else np.full(v.shape[1], np.nan, wide)


def ridge_cv(stats: DataFrame, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """(run_id, n, alpha, cv_r2, intercept, coef): alpha of the best mean fold r2, the first on ties, refitted on all folds.

    A task for each run and fold, and one for the refit of a run, makes one
    decomposition and answers for all alphas; it holds about five matrices as wide
    as the features. The best alpha is chosen by aggregation, of how far each is
    behind the best of its fold, which tells r2 apart that are equal as doubles.
    Runs with fewer than two rows a fold, or fewer than 5, get no row.
    """
    names = ["run_id", "fold", "k", "alpha", "n", "r2", "behind", "intercept", "coef"]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64()))

    def solve(t: pa.Table) -> pa.Table:
        run, fold, width, tile, folds = (t.column(c)[0].as_py() for c in ("run_id", "fold", "width", "tile", "folds"))
        parts, train = _read_tiles(t, "part"), matrix_of(width, tile, _read_tiles(t, "train"))
        n = int(round(train[0, 0] + (parts[0, 0][0] if parts else 0)))
        if n < max(5, 2 * folds) or folds < 2:
            return pa.table([pa.array([], k) for k in kinds], names)
        fits = fit_alphas(train, alphas)
        lost = _unexplained(width, tile, parts, np.array([[b, *w, -1.0] for b, w in fits]).T) if parts else np.full(len(fits), np.nan)
        r2, behind = ([float(x) if parts else None for x in of] for of in (1 - lost, lost - np.fmin.reduce(lost)))
        rows = [(run, fold, k, float(a), n, r, x, float(b), None if parts else w.tolist()) for k, (a, r, x, (b, w)) in enumerate(zip(alphas, r2, behind, fits, strict=True))]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "run_id string, fold int, k int, alpha double, n bigint, r2 double, behind double, intercept double, coef array<double>"
    solved = left_out(stats).groupBy("run_id", "fold").applyInArrow(solve, schema)
    whole = F.col("fold") < 0
    mean = solved.groupBy("run_id", "k", "alpha").agg(
        F.max("n").alias("n"), F.avg("r2").alias("cv_r2"), F.avg("behind").alias("behind"), F.max(F.when(whole, F.col("intercept"))).alias("intercept"), F.first("coef", ignorenulls=True).alias("coef")
    )
    best = mean.groupBy("run_id").agg(F.min_by(F.struct("n", "alpha", "cv_r2", "intercept", "coef"), F.struct("behind", "k")).alias("b"))  # NaN is the largest
    return best.select("run_id", "b.*")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def ridge_predict(rows: DataFrame, models: DataFrame, on: Sequence[str], lo: float | None = None, hi: float | None = None) -> DataFrame:
    """rows without x, with the other columns of every model that joins on the given columns, or of all models if
    there are none, and pred = intercept + coef . x, optionally clipped; null where x or one of its values is.

    Models go to all tasks, which multiply matrices, MODEL_BYTES at a time: the rows
    are not shuffled, and are read once for each such group of models.
    """
    on, models = list(on), stored(models, "models")
    size = models.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("coef")), F.lit(0)).alias("d")).first()
    groups = max(1, math.ceil(8 * size["n"] * (size["d"] + 2) / MODEL_BYTES))
    own = rows.withColumn("x", F.col("x").cast("array<double>"))
    if groups == 1:
        return _predicted(own, models, on, lo, hi)
    dealt = models.withColumn("_group", F.pmod(F.xxhash64("coef", "intercept"), F.lit(groups)))
    return reduce(DataFrame.unionByName, [_predicted(own, dealt.filter(F.col("_group") == g).drop("_group"), on, lo, hi) for g in range(groups)])


def _predicted(own: DataFrame, models: DataFrame, on: Sequence[str], lo: float | None, hi: float | None) -> DataFrame:
    """ridge_predict for models that fit into a task."""
    table = models.toArrow()
    extra = [c for c in table.column_names if c not in (*on, "intercept", "coef")]
    known: dict = {}
    for j, key in enumerate(zip(*(table.column(c).to_pylist() for c in on), strict=True) if on else [()] * len(table)):
        known.setdefault(key, []).append(j)
    coef = np.array(table.column("coef").to_pylist(), float).reshape(len(table), -1) if len(table) else np.empty((0, 0))
    shared = own.sparkSession.sparkContext.broadcast((known, np.array(table.column("intercept").to_pylist(), float), coef, table.select(extra)))
    kept = [c for c in own.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, intercept, coef, others = shared.value
        for whole in batches:
            for s in range(0, whole.num_rows, 1024):
                b = whole.slice(s, 1024)
                x = b.column("x")
                fine = x.is_valid().to_numpy(zero_copy_only=False)
                v = x.filter(pa.array(fine)).flatten().to_numpy(zero_copy_only=False).reshape(int(fine.sum()), -1)
                keys = list(zip(*(b.column(c).to_pylist() for c in on), strict=True)) if on else [()] * b.num_rows
                at = np.cumsum(fine) - 1
                where: dict = {}
                for i, key in enumerate(keys):
                    if key in known:
                        where.setdefault(key, []).append(i)
                for key, i in where.items():
                    i, m = np.array(i), np.array(known[key])
                    pred = np.full((len(i), len(m)), np.nan)
                    ok = fine[i]
                    if ok.any():
                        pred[ok] = v[at[i[ok]]] @ coef[m].T + intercept[m]
                    mine, theirs = np.repeat(i, len(m)), np.tile(m, len(i))
                    pred = pred.ravel()
                    cols = [b.column(c).take(pa.array(mine)) for c in kept] + [others.column(c).take(pa.array(theirs)).combine_chunks() for c in extra]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(pred, mask=np.isnan(pred))], [*kept, *extra, "pred"])

    types = dict(own.dtypes) | dict(models.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in (*kept, *extra)) + ", pred double"
    return own.mapInArrow(run, schema).withColumn("pred", clipped(F.col("pred"), lo, hi))


def ridge_sweep(stats: DataFrame, lambdas: Sequence[float], outcomes: Sequence[str] = ("y",), intercept: bool = True, leave_out: bool = True) -> DataFrame:
    """(run_id, fold, outcome, lambda, rcond, ill, r2, unexplained, intercept, coef): no standardisation; each fold's model is fitted on the other folds.

    With leave_out False there is one model of all rows, fold -1. rcond is the
    reciprocal condition of x'x + lambda I, ill whether it is below machine precision;
    r2 that of the predictions, not clipped, of the model's own fold, from its sums:
    the rows are not read for it. unexplained is 1 - r2, with more digits. Both are
    null for fold -1 and where y does not vary.
    """
    kinds = (pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64()))
    names = ["run_id", "fold", "outcome", "lambda", "rcond", "ill", "r2", "unexplained", "intercept", "coef"]
    outs = list(outcomes)

    def solve(t: pa.Table) -> pa.Table:
        run, fold, width, tile = (t.column(c)[0].as_py() for c in ("run_id", "fold", "width", "tile"))
        g, rows = matrix_of(width, tile, _read_tiles(t, "train")), []
        parts, d = _read_tiles(t, "part"), width - 1 - len(outs)
        xx, n = g[1 : d + 1, 1 : d + 1], g[0, 0]
        mean = g[0, 1 : d + 1] / n if intercept and n else np.zeros(d)
        values, vectors = np.linalg.eigh(xx - n * np.outer(mean, mean))
        for k, name in enumerate(outs):
            y_mean = g[0, d + 1 + k] / n if intercept and n else 0.0
            xy = vectors.T @ (g[1 : d + 1, d + 1 + k] - n * mean * y_mean)
            for lam in lambdas:
                s = values + lam
                rcond = float(max(s.min(), 0) / s.max()) if s.max() > 0 else 0.0
                w = vectors @ (xy / np.where(np.abs(s) > 1e-300, s, np.inf))
                b = float(y_mean - mean @ w)
                v = np.concatenate(([b], w, -np.eye(len(outs))[k]))[:, None]
                lost = _unexplained(width, tile, parts, v, d + 1 + k)[0] if parts else np.longdouble(np.nan)
                scores = (None, None) if np.isnan(lost) else (float(1 - lost), float(lost))
                rows.append((run, fold, name, float(lam), rcond, rcond < np.finfo(float).eps, *scores, b, w.tolist()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "run_id string, fold int, outcome string, lambda double, rcond double, ill boolean, r2 double, unexplained double, intercept double, coef array<double>"
    return left_out(stats).filter("fold >= 0" if leave_out else "fold < 0").groupBy("run_id", "fold").applyInArrow(solve, schema)


def kfold_sweep(
    df: DataFrame, lambdas: Sequence[float], outcomes: Sequence[str] = ("y",), intercept: bool = True, bounds: dict[str, tuple[float | None, float | None]] | None = None, run_bounds: DataFrame | None = None
) -> DataFrame:
    """Metrics of every fold, outcome and lambda: (run_id, fold, outcome, lambda, ill, r2, mse, rmse, mae, unexplained), from (run_id, fold, x, outcomes...).

    Predictions are clipped to the outcome's bounds, or to those of the run, from run_bounds (run_id, lo, hi).
    """
    models = ridge_sweep(sufficient_stats(df, outcomes), lambdas, outcomes, intercept).drop("r2", "unexplained")
    values = [F.col(o).cast("double").alias(f"_{i}") for i, o in enumerate(outcomes)]
    pred = ridge_predict(df.select("run_id", F.col("fold").cast("int").alias("fold"), "x", *values), models, ["run_id", "fold"])
    of = F.coalesce(*[F.when(F.col("outcome") == o, F.col(f"_{i}")) for i, o in enumerate(outcomes)])
    pred = pred.withColumn("y", of).drop(*[f"_{i}" for i in range(len(outcomes))])
    for o, (lo, hi) in (bounds or {}).items():
        pred = pred.withColumn("pred", F.when(F.col("outcome") == o, clipped(F.col("pred"), lo, hi)).otherwise(F.col("pred")))
    if run_bounds is not None:
        pred = pred.join(run_bounds.select("run_id", "lo", "hi"), "run_id").withColumn("pred", clipped(F.col("pred"), F.col("lo"), F.col("hi"))).drop("lo", "hi")
    by = ["run_id", "fold", "outcome", "lambda", "ill"]  # ill goes with the others
    return precise_metrics(pred.filter("y is not null"), by)


def single_solve(train: DataFrame, valid: DataFrame, lambdas: Sequence[float], intercept: bool = True) -> DataFrame:
    """kfold_sweep for one train and one validation table of (x, y)."""
    both = train.select("x", "y", F.lit(0).alias("fold")).unionByName(valid.select("x", "y", F.lit(1).alias("fold")))
    return kfold_sweep(both.withColumn("run_id", F.lit("single")), lambdas, intercept=intercept).filter("fold = 1")


def best_hyperparameter(metrics: DataFrame, criterion: str = "r2", minimize: bool = False) -> DataFrame:
    """(run_id, outcome, lambda, score, at_edge, tied): the best mean over folds, the least lambda on ties.

    A lambda that is ill-conditioned in any fold does not count; an outcome
    without any other is an error. at_edge: the best is an end of the grid. Where
    the metrics have unexplained, r2 are compared by it: how far each lambda is behind
    the best of its fold keeps digits that a double near 1 has not.
    """
    by = ["run_id", "outcome"]
    own, worth = metrics, F.col("score") if minimize else -F.col("score")
    if criterion == "r2" and not minimize and "unexplained" in metrics.columns:
        own, worth = metrics.withColumn("behind", F.col("unexplained") - F.min("unexplained").over(Window.partitionBy(*by, "fold"))), F.col("behind")
    mean = own.groupBy(*by, "lambda").agg(F.avg(criterion).alias("score"), F.max("ill").alias("ill"), *[F.avg(c).alias(c) for c in own.columns if c == "behind"])
    fine = mean.filter("not ill").withColumn("w", worth)
    best = fine.groupBy(*by).agg(F.min(F.struct("w", "lambda", "score")).alias("b"), F.min("lambda").alias("lo"), F.max("lambda").alias("hi"))
    ties = fine.join(best.select(*by, F.col("b.w").alias("bw")), by).filter("w = bw").groupBy(*by).agg(F.count("*").alias("ties"))
    every = metrics.select(*by).distinct().join(best, by, "left").join(ties, by, "left")
    lam = F.when(F.col("b").isNull(), F.raise_error(F.concat(F.lit("no well-conditioned lambda for "), "outcome")).cast("double")).otherwise(F.col("b.lambda"))
    return every.select(*by, lam.alias("lambda"), F.col("b.score").alias("score"), ((F.col("b.lambda") == F.col("lo")) | (F.col("b.lambda") == F.col("hi"))).alias("at_edge"), (F.col("ties") > 1).alias("tied"))


def best_fold_results(metrics: DataFrame, best: DataFrame) -> DataFrame:
    """The metrics, or the models of ridge_sweep, of every fold at the chosen lambda."""
    return metrics.join(best.select("run_id", "outcome", "lambda"), ["run_id", "outcome", "lambda"])


def best_fold_predictions(df: DataFrame, models: DataFrame, best: DataFrame, outcomes: Sequence[str] = ("y",)) -> DataFrame:
    """(run_id, fold, id, outcome, lambda, y, pred): every row's prediction by its own fold's model at the chosen lambda."""
    chosen = best_fold_results(models, best).select("run_id", "fold", "outcome", "lambda", "intercept", "coef")
    values = [F.col(o).cast("double").alias(f"_{i}") for i, o in enumerate(outcomes)]
    pred = ridge_predict(df.select("run_id", F.col("fold").cast("int").alias("fold"), "id", "x", *values), chosen, ["run_id", "fold"])
    of = F.coalesce(*[F.when(F.col("outcome") == o, F.col(f"_{i}")) for i, o in enumerate(outcomes)])
    return pred.withColumn("y", of).select("run_id", "fold", "id", "outcome", "lambda", "y", "pred")


def regional_cv(df: DataFrame, lambdas: Sequence[float], k: int = 5, seed: str = "fold", frac_test: float = 0.2, global_clip: bool = False) -> DataFrame:
    """Best lambda and its mean r2 in every region, from (id, region, x, y): 20 % held out, k folds on the rest.

    Predictions are clipped to the least and greatest y of the region, or of all regions.
    """
    own = df.withColumn("run_id", F.col("region").cast("string"))
    ends = own.groupBy("run_id").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    if global_clip:
        ends = ends.select("run_id").join(F.broadcast(own.agg(F.min("y").alias("lo"), F.max("y").alias("hi"))))
    ranked = hash_ranked(own, seed + "|test", "id", by=["run_id"])
    counts = own.groupBy("run_id").agg(F.count("*").alias("n"))
    train = ranked.join(counts, "run_id").filter(F.col("rank") >= F.floor(F.col("n") * frac_test)).select("run_id", "id", "x", "y")
    folded = stored(with_folds(stored(train, "train"), k, seed).drop("id"), "folded")  # ranks are joined and sorted once
    return best_hyperparameter(kfold_sweep(folded, lambdas, run_bounds=stored(ends, "bounds")))


def min_sample_guard(samples: DataFrame, least: int) -> DataFrame:
    """Rows of the runs that have at least `least` rows."""
    enough = samples.groupBy("run_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("run_id")
    return samples.join(enough, "run_id", "left_semi")


def _union(tables: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def score_samples(samples: DataFrame, population: DataFrame, folds: int = 5, seed: str = "cv", alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """(run_id, n, alpha, r2, mse, rmse, mae): each stored sample's model on the test split.

    samples: (run_id, id); population: (id, x, y, split). All runs are fitted in one
    job. The samples' rows are stored when they have met the population, and again
    with their folds: neither the join nor the sort is made more than once. Both are
    made in slices of about SLICE_ROWS rows of the samples, by hashes, one after the
    other, so that no more than a slice lies in shuffle files; the tables are read
    once for each.
    """
    spark, slices = samples.sparkSession, max(1, math.ceil(samples.count() / SLICE_ROWS))
    known = population.filter("split = 'train'").select("id", "x", "y")

    def of(df: DataFrame, k: int) -> DataFrame:
        return df if slices == 1 else df.filter(F.pmod(F.xxhash64("id"), F.lit(slices)) == k)

    mark = stored_so_far()
    # dealt by id once, for the distinct rows and for the join, which sorts them by id: repeated ids take little room
    train = _union(stored(of(samples.select("run_id", "id"), k).repartition("id").distinct().join(of(known, k), "id").select("run_id", "id", "x", "y"), "train") for k in range(slices))
    enough = train.groupBy("run_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= 2 * folds).select("run_id")
    own = train.join(F.broadcast(enough), "run_id", "left_semi")  # a row for each run
    ranked = hash_ranked_in_slices(own, F.concat(F.lit(f"{seed}|"), "run_id"), "id", ["run_id"], [], None, slices)
    parts = [stored(t.select("run_id", (F.col("rank") % folds).cast("int").alias("fold"), "x", "y"), "folded") for t in ranked]
    erase_since(spark, mark, *parts)
    folded = _union(parts)
    models = ridge_cv(sufficient_stats(folded), alphas)
    pred = ridge_predict(population.filter("split = 'test'").select("x", "y"), models, [])
    return pred.filter("y is not null").groupBy("run_id").agg(F.first("n").alias("n"), F.first("alpha").alias("alpha"), *metric_columns(F.col("y"), F.col("pred")))


def evaluate_round(population: DataFrame, status: DataFrame, selection: DataFrame, **options) -> DataFrame:
    """Scores before and after a selection: run_id initial and updated. status: (id, status)."""
    lab = status.filter("status = 'labeled'").select("id")
    before, after = lab.withColumn("run_id", F.lit("initial")), lab.unionByName(selection.select("id")).distinct().withColumn("run_id", F.lit("updated"))
    return score_samples(before.unionByName(after).select("run_id", "id"), population, **options)


def scene_regression(train: DataFrame, scene: DataFrame, outcomes: Sequence[str], lam: float, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """(id, outcome, pred) of the scene's rows for every outcome at one lambda, within each outcome's bounds."""
    own = train.withColumns({"run_id": F.lit("scene"), "fold": F.lit(0)})
    models = ridge_sweep(sufficient_stats(own, outcomes), [lam], outcomes, leave_out=False).select("outcome", "intercept", "coef")
    pred = ridge_predict(scene.select("id", "x"), models, [])
    for o, (lo, hi) in bounds.items():
        pred = pred.withColumn("pred", F.when(F.col("outcome") == o, clipped(F.col("pred"), lo, hi)).otherwise(F.col("pred")))
    return pred.select("id", "outcome", "pred")


def bounded_ridge(train: DataFrame, rows: DataFrame, alpha: float, lo: float | None, hi: float | None) -> DataFrame:
    """(id, pred): ridge without intercept, predictions within bounds."""
    own = train.withColumns({"run_id": F.lit("bounded"), "fold": F.lit(0)})
    models = ridge_sweep(sufficient_stats(own), [alpha], intercept=False, leave_out=False).select("intercept", "coef")
    return ridge_predict(rows.select("id", "x"), models, [], lo, hi).select("id", "pred")


