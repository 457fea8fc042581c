"""Results mart: parsed run logs, deltas, summaries over seeds, comparison tables.

Long tables carry (dataset, init_set, cost_type, budget, method, seed, metric,
phase, value); a run key is (dataset, init_set, cost_type, budget).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import format_cell

KEY = ("dataset", "init_set", "cost_type", "budget")
METRICS = ("r2", "mse", "rmse", "mae")

# The lines of a run log, with the number class that they allow.
NUMBER = r"(-?[0-9.]+)"
LOG_LINES = {
    "initial_r2": "Initial R² score: " + NUMBER,
    "updated_r2": "Updated R² score: " + NUMBER,
    "initial_mse": "Initial MSE: " + NUMBER,
    "updated_mse": "Updated MSE: " + NUMBER,
    "initial_rmse": "Initial RMSE: " + NUMBER,
    "updated_rmse": "Updated RMSE: " + NUMBER,
    "initial_mae": "Initial MAE: " + NUMBER,
    "updated_mae": "Updated MAE: " + NUMBER,
    "size": r"(?:Selected (?=\d+ new samples)|Sampled (?=\d+ points))(\d+)",
}


def parse_metrics(text: Column) -> list[Column]:
    """A double for each line of a log: the first match, null where absent."""
    return [F.regexp_extract(text, p, 1).try_cast("double").alias(k) for k, p in LOG_LINES.items()]


def parse_run_path(path: Column, datasets: Sequence[str]) -> Column:
    """Struct (dataset, init_set, cost_type, method, budget, seed) of the folder of a run; null when no dataset is in the path.

    A nested sampling design ('multiple...') puts the initial set one level
    deeper; empty_initial_set is found at any place after the dataset; methods
    that start with poprisk carry their group type and lambda.
    """

    # lambdas over a one-element array bind each intermediate value once
    def places(parts: Column) -> Column:
        at = reduce(lambda c, d: F.when(F.array_position(parts, d) > 0, F.array_position(parts, d)).otherwise(c), datasets, F.lit(0).cast("long"))
        return F.struct(parts.alias("parts"), at.alias("at"), F.array_position(parts, "empty_initial_set").alias("empty"), F.array_position(parts, "opt").alias("opt"))

    def starts(s: Column) -> Column:
        near = F.slice(s["parts"], (s["at"] + 1).cast("int"), 5)
        nested = F.array_contains(near, "multiple") | F.array_contains(near, "multiple_cluster_sampling")
        init = F.when(s["empty"] > s["at"], s["empty"]).when(nested, s["at"] + 4).otherwise(s["at"] + 3)
        return F.struct(s["parts"].alias("parts"), s["at"].alias("at"), s["opt"].alias("opt"), init.alias("init"))

    def fields(s: Column) -> Column:
        part = lambda i: F.get(s["parts"], (i - 1).cast("int"))  # noqa: E731  1-based
        base = F.when(s["opt"] > 0, s["opt"] + 1).otherwise(s["init"] + 2)
        risky = (s["opt"] > 0) & part(base).startswith("poprisk")
        method = F.when(risky, F.concat_ws("_", part(base), part(base + 1), F.regexp_replace(part(base + 3), "util_lambda_", ""))).otherwise(part(base))
        budget = F.regexp_replace(F.when(risky, part(base + 2)).otherwise(part(base + 1)), "budget_", "")
        seed = F.get(F.split(F.element_at(s["parts"], -1), "_"), F.lit(1))
        init = F.regexp_replace(part(s["init"]), r"_seed_\d+", "")
        own = F.struct(part(s["at"]).alias("dataset"), init.alias("init_set"), part(s["init"] + 1).alias("cost_type"), method.alias("method"), budget.alias("budget"), seed.alias("seed"))
        return F.when(s["at"] > 0, own)

    run = F.get(F.transform(F.transform(F.transform(F.array(F.split(F.trim(path), "/")), places), starts), fields), F.lit(0))
    return F.when(run["budget"].isNotNull() & run["seed"].isNotNull(), run)


def parse_sample_name(name: Column, kind: str) -> list[Column]:
    """Metadata in a sample's file name: kind is cluster, convenience or random."""
    base = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.pkl$", "")
    parts = F.split(base, "_")
    none = lambda c: F.nullif(c, F.lit(""))
    if kind == "random":
        return [none(F.regexp_extract(name, r"random_sample_(\d+)_points_seed_(\d+)\.pkl$", i)).cast("int").alias(k) for i, k in ((1, "sample_size"), (2, "seed"))]
    if kind == "cluster":
        from_end = lambda i: F.element_at(parts, -i)
        return [from_end(1).alias("seed"), F.regexp_replace(from_end(4), "ppc", "").alias("points_per_cluster"), F.get(parts, F.lit(3)).alias("strata"), F.get(parts, F.lit(4)).alias("cluster")]
    if kind != "convenience":
        raise ValueError(kind)
    place = lambda word: F.array_position(parts, word)
    seeded = place("seed") > 0
    source = reduce(lambda c, s: F.when(F.contains(name, F.lit(s)), s).otherwise(c), ("cluster_based", "region_based", "urban_based"), F.lit("unknown"))
    before = lambda word: F.when(place(word) > 1, F.get(parts, (place(word) - 2).cast("int"))).cast("int")
    return [
        source.alias("source"), F.when(seeded, F.element_at(parts, -1)).alias("seed"), F.when(seeded, F.element_at(parts, -2)).alias("method"),
        none(F.regexp_extract(base, r"(?:^|_)top(\d+)", 1)).cast("int").alias("num_urban"),
        F.when(place("cluster") > 0, F.get(parts, place("cluster").cast("int"))).alias("cluster_type"),
        before("ppc").alias("points_per_cluster"), before("clusters").alias("num_clusters"),
    ]


def initial_size(init_set: Column) -> Column:
    """The number in '<n>_size'; 0 for empty_initial_set; else null."""
    return F.when(init_set == "empty_initial_set", 0).otherwise(F.nullif(F.regexp_extract(init_set, r"_(\d+)_size", 1), F.lit("")).cast("int"))


def collect_runs(logs: DataFrame, datasets: Sequence[str], **only: str) -> DataFrame:
    """(path, key columns, method, seed, metrics) of logs (path, text), optionally of given key values; unparsable ones are left out."""
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    own = logs.select("path", parse_run_path(folder, datasets).alias("run"), *parse_metrics(F.col("text"))).filter("run.dataset is not null")
    own = own.select("path", "run.*", *LOG_LINES)
    for column, value in only.items():
        own = own.filter(F.col(column) == value)
    return own


def bad_logs(logs: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """Paths that hold no run."""
    return logs.filter(parse_run_path(F.regexp_replace("path", r"/[^/]*$", ""), datasets).isNull()).select("path")


def long_metrics(runs: DataFrame) -> DataFrame:
    """One row per run, phase and metric that its log has."""
    fields = [F.struct(F.lit(p).alias("phase"), F.lit(m).alias("metric"), F.col(f"{p}_{m}").alias("value")) for p in ("initial", "updated") for m in METRICS]
    own = runs.select("path", *KEY, "method", "seed", F.explode(F.array(*fields)).alias("f"))
    return own.select("path", *KEY, "method", "seed", "f.*").filter("value is not null")


def first_per_seed(long: DataFrame, order: str = "path") -> DataFrame:
    """The first value, by path, of every key, method, phase, metric and seed."""
    by = [*KEY, "method", "phase", "metric", "seed"]
    return long.groupBy(*by).agg(F.min_by("value", order).alias("value"))


def complete_seed_runs(long: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Rows of expected seeds of the methods that have all of them, for each key, phase and metric."""
    by = [*KEY, "method", "phase", "metric"]
    own = long.filter(F.col("seed").isin(list(expected)))
    full = own.groupBy(*by).agg(F.count_distinct("seed").alias("n")).filter(F.col("n") == len(set(expected))).drop("n")
    return own.join(full, by, "left_semi")


def delta_metrics(long: DataFrame) -> DataFrame:
    """(key, method, metric, seed, delta): the gain, positive when the update is better."""
    by = [*KEY, "method", "metric", "seed"]
    phase = lambda p: F.max(F.when(F.col("phase") == p, F.col("value")))
    own = long.groupBy(*by).agg(phase("initial").alias("i"), phase("updated").alias("u")).filter("i is not null and u is not null")
    return own.select(*by, F.when(F.col("metric") == "r2", F.col("u") - F.col("i")).otherwise(F.col("i") - F.col("u")).alias("delta"))


def seed_summary(rows: DataFrame, by: Sequence[str], value: str = "value", digits: int = 2) -> DataFrame:
    """(by..., n, mean, std, se): mean and population deviation rounded half to even, standard error from the sample deviation."""
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.bround(F.avg(value), digits).alias("mean"),
        F.bround(F.stddev_pop(value), digits).alias("std"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"),
    )


def summary_wide(long: DataFrame, methods: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row per key: {method}_{updated,delta}_{metric}_{mean,std,se}, initial sizes and alpha-ready columns."""
    updated = long.filter("phase = 'updated'").select(*KEY, "method", "seed", F.concat(F.lit("updated_"), "metric").alias("what"), "value")
    delta = delta_metrics(long).select(*KEY, "method", "seed", F.concat(F.lit("delta_"), "metric").alias("what"), F.col("delta").alias("value"))
    own = updated.unionByName(delta).withColumn("col", F.concat_ws("_", "method", "what"))
    cols = [f"{m}_{p}_{k}" for m in methods for p in ("updated", "delta") for k in metrics]
    stats = [F.bround(F.avg("value"), 2).alias("mean"), F.bround(F.stddev_pop("value"), 2).alias("std"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("se")]
    return own.groupBy(*KEY).pivot("col", cols).agg(*stats).withColumn("initial_size", initial_size(F.col("init_set")))


def initial_summary(initial: DataFrame) -> DataFrame:
    """(size, metric, n, mean, std, se) of (size, seed, metric, value)."""
    return seed_summary(initial, ["size", "metric"])


def default_comparator(runs: DataFrame, initial: DataFrame) -> DataFrame:
    """Adds default_<stat> of the initial-set metrics whose size is initial size plus budget."""
    own = runs.withColumn("_size", F.col("initial_size") + F.col("budget").cast("int"))
    ref = initial.select(F.col("size").alias("_size"), "metric", *[F.col(c).alias(f"default_{c}") for c in ("mean", "std", "se")])
    return own.join(ref, ["_size", "metric"], "left").drop("_size")


def r2_only_summary(long: DataFrame, least_initial: int = 10, least_method: int = 5, exempt: Sequence[str] = ()) -> DataFrame:
    """Summaries of updated r2 without the rule of complete seeds, for keys with enough initial and methods with enough values."""
    r2 = long.filter("metric = 'r2'")
    first = r2.filter("phase = 'initial'").groupBy(*KEY, "seed").agg(F.min_by("value", "method").alias("value"))
    enough = first.groupBy(*KEY).agg(F.count("*").alias("n"), F.bround(F.avg("value"), 2).alias("initial_mean"), F.bround(F.stddev_pop("value"), 2).alias("initial_std"))
    enough = enough.filter((F.col("n") >= least_initial) | F.col("dataset").isin(list(exempt))).drop("n")
    own = seed_summary(r2.filter("phase = 'updated'"), [*KEY, "method"])
    return own.filter((F.col("n") >= least_method) | F.col("dataset").isin(list(exempt))).join(enough, list(KEY))


def selected_size_summary(runs: DataFrame) -> DataFrame:
    return runs.filter("size is not null").groupBy(*KEY, "method").agg(F.bround(F.avg("size"), 1).alias("mean"), F.bround(F.stddev_pop("size"), 1).alias("std"))


def results_table(summary: DataFrame, methods: Sequence[str], err: str = "std", row: str = "budget") -> DataFrame:
    """A row per budget, a column per method in the given order: 'mean ± error' or '--'."""
    cell = F.first(format_cell(F.col("mean"), F.col(err)))
    wide = summary.groupBy(row).pivot("method", list(methods)).agg(cell)
    return wide.select(row, *[F.coalesce(F.col(f"`{m}`"), F.lit("--")).alias(m) for m in methods])


def alpha_curve(summary: DataFrame, budget: str) -> DataFrame:
    """(method, alpha, mean, se) at one budget; alpha 0 does not count for greedycost."""
    own = summary.filter((F.col("budget") == budget) & ~((F.col("alpha") == 0) & (F.col("method") == "greedycost")))
    return own.select("method", "alpha", "mean", "se")


def cost_curve(initial: DataFrame, updated: DataFrame, sizes: Sequence[int], most: int) -> DataFrame:
    """(initial_size, method, cost, value, se): an anchor (size, initial mean, 0) and a point (size + budget, updated mean, se) for each budget up to most."""
    own = updated.filter(F.col("initial_size").isin(list(sizes)) & (F.col("budget").cast("int") <= most))
    start = own.select("initial_size", "method").distinct().join(initial.select(F.col("size").alias("initial_size"), F.col("mean").alias("value")), "initial_size")
    anchors = start.select("initial_size", "method", F.col("initial_size").cast("int").alias("cost"), "value", F.lit(0.0).alias("se"))
    return anchors.unionByName(own.select("initial_size", "method", (F.col("initial_size") + F.col("budget").cast("int")).alias("cost"), F.col("mean").alias("value"), "se"))


def merge_utilities_with_r2(utilities: DataFrame, scores: DataFrame, types: Sequence[str]) -> DataFrame:
    """Inner join on initial set, size and sampling type, the type being the known prefix of a longer name."""
    base = reduce(lambda c, t: F.when(F.col("sampling_type").startswith(t), t).otherwise(c), sorted(types, key=len), F.lit(None).cast("string"))
    return utilities.withColumn("base_sampling_type", base).join(scores, ["initial_set", "size", "base_sampling_type"])


def experiment_grid(spark: SparkSession, methods: Sequence[str], budgets: Sequence[int], seeds: Sequence[int], lambdas: Sequence[float] = (), alphas: Sequence[float] = (0.0,), group_types: Sequence[str] = ("none",), sizes: Sequence[int] = (0,), per_unit: int = 10) -> DataFrame:
    """Every run of a study: lambda only for methods that start with poprisk; region costs c1 = per_unit, c2 = per_unit + alpha."""
    lam = F.when(F.col("method").startswith("poprisk"), F.array(*[F.lit(float(x)) for x in lambdas])).otherwise(F.array(F.lit(None).cast("double")))
    own = spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
    for name, values in (("budget", budgets), ("seed", seeds), ("alpha", [float(a) for a in alphas]), ("group_type", group_types), ("size", sizes)):
        own = own.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    own = own.withColumn("lambda", F.explode(lam)).withColumns({"c1": F.lit(float(per_unit)), "c2": F.lit(float(per_unit)) + F.col("alpha")})
    return own.withColumn("run_id", F.concat_ws("/", "method", "group_type", F.format_string("size_%d", "size"), F.format_string("budget_%d", "budget"), F.concat(F.lit("lambda_"), F.col("lambda").cast("string")), F.concat(F.lit("alpha_"), F.col("alpha").cast("string")), F.format_string("seed_%d", "seed")))


def skip_done_runs(grid: DataFrame, done: DataFrame, always: Sequence[str] = ("similarity", "diversity")) -> DataFrame:
    """Runs without a result; methods in always are run again."""
    again = grid.filter(F.col("method").isin(list(always)))
    return grid.filter(~F.col("method").isin(list(always))).join(done.select("run_id"), "run_id", "left_anti").unionByName(again.select("run_id", *[c for c in grid.columns if c != "run_id"]))


def map_layer(population: DataFrame, sample: DataFrame) -> DataFrame:
    """All points with in_sample, for mapping tools."""
    own = population.select("id", "lon", "lat").join(sample.select("id", F.lit(True).alias("_in")).distinct(), "id", "left")
    return own.select("id", "lon", "lat", F.coalesce("_in", F.lit(False)).alias("in_sample"))


