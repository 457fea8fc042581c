"""Queries: run logs and the results mart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import results
from . import fixtures as fx

DATASETS = ("TOGO_PH_H2O",)
SEEDS = [str(i) for i in range(10)]
METHODS = ["click", "purchase", "view"]


def _runs(spark, d):
    return results.collect_runs(fx.run_logs(spark, d).select("path", "text"), DATASETS)


def _long(spark, d):
    return results.first_per_seed(results.long_metrics(_runs(spark, d)))


def parsed(spark, d):
    return _runs(spark, d).drop("initial_rmse", "updated_rmse", "initial_mae", "updated_mae", "path")


def rejected(spark, d):
    logs = fx.run_logs(spark, d)
    return results.bad_logs(logs.withColumn("path", F.when(F.col("user_id") % 5 == 0, F.regexp_replace("path", "TOGO_PH_H2O", "OTHER")).otherwise(F.col("path"))), DATASETS).groupBy().agg(F.count("*").alias("n"))


def firsts(spark, d):
    return _long(spark, d)


def complete(spark, d):
    return results.complete_seed_runs(_long(spark, d).filter("not (seed = '4' and method = 'click')"), [s for s in SEEDS if int(s) % 2 == 0])


def deltas(spark, d):
    own = results.delta_metrics(_long(spark, d))
    return own.withColumn("delta", F.bround("delta", 6))


def _summary(spark, d):
    return results.seed_summary(_long(spark, d).filter("phase = 'updated' and metric = 'mse'"), [*results.KEY, "method"])


def seed_summary(spark, d):
    return _summary(spark, d).withColumn("se", F.bround("se", 6))


def wide(spark, d):
    own = results.summary_wide(_long(spark, d), METHODS, ("mse",))
    return own.select(*results.KEY, *[F.bround(f"{m}_{p}_mse_{s}", 2).alias(f"{m}_{p}_{s}") for m in METHODS for p in ("updated", "delta") for s in ("mean", "std")], "initial_size")


def _initial(spark, d):
    long = _long(spark, d).filter("phase = 'initial'")
    own = long.withColumn("size", results.initial_size(F.col("init_set")))
    return results.initial_summary(own.groupBy("size", "metric", "seed").agg(F.min("value").alias("value")))


def initial(spark, d):
    return _initial(spark, d).withColumn("se", F.bround("se", 6))


def comparator(spark, d):
    long = _summary(spark, d).withColumns({"initial_size": results.initial_size(F.col("init_set")) - 200, "metric": F.lit("mse")})
    ref = _initial(spark, d)
    return results.default_comparator(long, ref).select(*results.KEY, "method", "default_mean")


def r2_only(spark, d):
    return results.r2_only_summary(_long(spark, d), 5, 3).drop("se")


def sizes(spark, d):
    return results.selected_size_summary(_runs(spark, d))


def table(spark, d):
    own = _summary(spark, d).filter("init_set = 'multi_50_size'")
    return results.results_table(own, METHODS)


def alpha(spark, d):
    own = _summary(spark, d).withColumn("alpha", F.length("method") % 3).withColumn("method", F.when(F.col("method") == "click", "greedycost").otherwise(F.col("method")))
    return results.alpha_curve(own, "200").select("method", "alpha", "mean")


def cost(spark, d):
    own = _summary(spark, d).withColumn("initial_size", results.initial_size(F.col("init_set")))
    return results.cost_curve(_initial(spark, d).filter("metric = 'mse'"), own, [50], 200).withColumn("se", F.bround("se", 6))


def utilities(spark, d):
    k = F.col("c_custkey")
    kind = F.element_at(F.array(F.lit("random"), F.lit("cluster")), (k % 2 + 1).cast("int"))
    own = fx.table(spark, d, "customer").select(F.concat(F.lit("set"), F.floor(k / 3)).alias("initial_set"), (k % 3).alias("size"), F.concat(kind, F.lit("_x"), k).alias("sampling_type"), k.cast("double").alias("utility"))
    scores = fx.table(spark, d, "customer").filter(k % 3 == 0)
    scores = scores.select(F.concat(F.lit("set"), F.floor(k / 3)).alias("initial_set"), F.explode(F.array(*[F.lit(i).cast("long") for i in range(2)])).alias("size"), F.lit("cluster").alias("base_sampling_type"), (k / 10).alias("r2"))
    return results.merge_utilities_with_r2(own, scores, ["random", "cluster"])


def grid(spark, d):
    used = fx.table(spark, d, "customer").select(F.col("c_name").alias("dataset"))
    own = results.experiment_grid(spark, ["random", "poprisk"], [100, 200], [1, 2, 3], lambdas=[0.1, 0.5], alphas=[0.0, 5.0])
    done = own.filter("seed = 1").select("run_id")
    return used.join(F.broadcast(results.skip_done_runs(own, done))).groupBy("dataset", "method", "c2").agg(F.count("*").alias("runs"))  # a grid of given values


def layer(spark, d):
    g = fx.geo(spark, d)
    return results.map_layer(g, g.filter("nation = 3").select("id")).select("id", "in_sample")


def names(spark, d):
    u = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    rnd = u.select("k", *results.parse_sample_name(F.format_string("x/random_sample_%d_points_seed_%d.pkl", F.col("k") * 10, "k"), "random"))
    clu = u.select("k", *[c.alias(f"c_{i}") for i, c in enumerate(results.parse_sample_name(F.format_string("x/sample_by_cluster_state_county_%dppc_%d_seed_%d.pkl", "k", F.col("k") * 10, "k"), "cluster"))])
    con = u.select("k", *[c.alias(f"v_{i}") for i, c in enumerate(results.parse_sample_name(F.format_string("x/urban_based_top%d_%d_clusters_%d_ppc_cluster_adm2_n_seed_prob_%d.pkl", "k", F.col("k") + 1, F.col("k") + 2, "k"), "convenience"))])
    return rnd.join(clu, "k").join(con, "k")


def run_keys(spark, d):
    own = fx.table(spark, d, "customer").withColumn("m", F.when(F.col("c_custkey") % 2 == 0, "poprisk").otherwise("random"))
    opt = F.col("m") == "poprisk"
    return own.select("c_custkey", keys.run_key(F.lit("init"), F.lit("uniform"), F.col("m"), F.when(opt, "state"), F.lit(100), F.when(opt, F.lit(0.5)), F.col("c_custkey"), opt).alias("run_key"))


RUNS = f"""WITH {fx.LOGS}, runs AS (SELECT 'TOGO_PH_H2O' AS dataset, init_set, 'uniform' AS cost_type, budget::VARCHAR AS budget, event_type AS method, seed::VARCHAR AS seed, user_id || '/' AS p, n, v FROM log)"""
LONG = f"""{RUNS}, r AS (SELECT dataset, init_set, cost_type, budget, method, seed, arg_min(v, p) AS v FROM runs GROUP BY ALL),
long AS (SELECT dataset, init_set, cost_type, budget, method, seed, unnest(['initial', 'initial', 'updated', 'updated']) AS phase, unnest(['r2', 'mse', 'r2', 'mse']) AS metric, unnest([floor(v / 20) / 100, v + 100, floor(v / 10) / 100, v]) AS value FROM r)"""
BY = "dataset, init_set, cost_type, budget"
STATS = "count(value) AS n, round_even(avg(value), 2) AS mean, round_even(stddev_pop(value), 2) AS std"
SUMMARY = f"s AS (SELECT {BY}, method, {STATS}, round_even(stddev_samp(value) / sqrt(count(value)), 6) AS se FROM long WHERE phase = 'updated' AND metric = 'mse' GROUP BY {BY}, method)"

QUERIES = {
    "collect_runs": parsed, "bad_logs": rejected, "first_per_seed": firsts, "complete_seed_runs": complete, "delta_metrics": deltas, "seed_summary": seed_summary, "summary_wide": wide, "initial_summary": initial,
    "default_comparator": comparator, "r2_only_summary": r2_only, "selected_size_summary": sizes, "results_table": table, "alpha_curve": alpha, "cost_curve": cost, "merge_utilities_with_r2": utilities,
    "experiment_grid": grid, "map_layer": layer, "parse_sample_name": names, "run_key": run_keys,
}
INITIAL = f"i AS (SELECT regexp_extract(init_set, '_(\\d+)_size', 1)::INT AS size, metric, seed, min(value) AS value FROM long WHERE phase = 'initial' GROUP BY ALL), ini AS (SELECT size, metric, {STATS}, round_even(stddev_samp(value) / sqrt(count(value)), 6) AS se FROM i GROUP BY size, metric)"
DELTA = f"d AS (SELECT {BY}, method, metric, seed, CASE metric WHEN 'r2' THEN 1 ELSE -1 END * (max(value) FILTER (phase = 'updated') - max(value) FILTER (phase = 'initial')) AS delta FROM long GROUP BY {BY}, method, metric, seed)"
CELL = "CASE WHEN mean IS NULL OR std IS NULL THEN '--' ELSE printf('%.2f', mean) || ' ± ' || printf('%.2f', std) END"
_wide = ", ".join(f"round_even({f}({v}) FILTER (method = '{m}'), 2) AS {m}_{p}_{n}" for m in METHODS for p, v in (("updated", "u"), ("delta", "delta")) for n, f in (("mean", "avg"), ("std", "stddev_pop")))
ORACLE_SQL = {
    "collect_runs": f"{RUNS} SELECT dataset, init_set, cost_type, budget, method, seed, floor(v / 20) / 100 AS initial_r2, floor(v / 10) / 100 AS updated_r2, v + 100 AS initial_mse, v AS updated_mse, n::DOUBLE AS size FROM runs",
    "first_per_seed": f"{LONG} SELECT {BY}, method, phase, metric, seed, value FROM long",
    "complete_seed_runs": f"""{LONG}, own AS (SELECT * FROM long WHERE seed IN ('0', '2', '4', '6', '8') AND NOT (seed = '4' AND method = 'click'))
SELECT {BY}, method, phase, metric, seed, value FROM own QUALIFY count(*) OVER (PARTITION BY {BY}, method, phase, metric) = 5""",
    "delta_metrics": f"{LONG}, {DELTA} SELECT {BY}, method, metric, seed, round_even(delta, 6) AS delta FROM d",
    "seed_summary": f"{LONG}, {SUMMARY} SELECT * FROM s",
    "summary_wide": f"""{LONG}, {DELTA}, both_ AS (SELECT d.*, l.value AS u FROM d JOIN long l USING ({BY}, method, metric, seed) WHERE metric = 'mse' AND phase = 'updated')
SELECT {BY}, {_wide}, regexp_extract(init_set, '_(\\d+)_size', 1)::INT AS initial_size FROM both_ GROUP BY {BY}""",
    "initial_summary": f"{LONG}, {INITIAL} SELECT * FROM ini",
    "default_comparator": f"""{LONG}, {INITIAL}, {SUMMARY} SELECT {BY}, method, ini.mean AS default_mean FROM s LEFT JOIN ini ON ini.metric = 'mse' AND ini.size = regexp_extract(init_set, '_(\\d+)_size', 1)::INT - 200 + budget::INT""",
    "r2_only_summary": f"""{LONG}, f AS (SELECT {BY}, seed, arg_min(value, method) AS value FROM long WHERE phase = 'initial' AND metric = 'r2' GROUP BY {BY}, seed),
i AS (SELECT {BY}, count(*) AS n, round_even(avg(value), 2) AS initial_mean, round_even(stddev_pop(value), 2) AS initial_std FROM f GROUP BY {BY}),
u AS (SELECT {BY}, method, {STATS} FROM long WHERE phase = 'updated' AND metric = 'r2' GROUP BY {BY}, method) SELECT u.*, initial_mean, initial_std FROM u JOIN i USING ({BY}) WHERE i.n >= 5 AND u.n >= 3""",
    "selected_size_summary": f"{RUNS} SELECT {BY}, method, round_even(avg(n), 1) AS mean, round_even(stddev_pop(n), 1) AS std FROM runs GROUP BY {BY}, method",
    "results_table": f"{LONG}, {SUMMARY}, c AS (SELECT budget, method, {CELL} AS cell FROM s WHERE init_set = 'multi_50_size') SELECT budget, " + ", ".join(f"coalesce(max(cell) FILTER (method = '{m}'), '--') AS {m}" for m in METHODS) + " FROM c GROUP BY budget",
    "alpha_curve": f"{LONG}, {SUMMARY} SELECT CASE method WHEN 'click' THEN 'greedycost' ELSE method END AS method, (length(method) % 3)::INT AS alpha, mean FROM s WHERE budget = '200' AND NOT (method = 'click' AND length(method) % 3 = 0)",
    "cost_curve": f"""{LONG}, {INITIAL}, {SUMMARY}, own AS (SELECT * FROM s WHERE init_set = 'multi_50_size' AND budget::INT <= 200)
SELECT 50 AS initial_size, method, 50 AS cost, ini.mean AS value, 0.0::DOUBLE AS se FROM (SELECT DISTINCT method FROM own), ini WHERE ini.size = 50 AND ini.metric = 'mse'
UNION ALL SELECT 50, method, 50 + budget::INT, mean, se FROM own""",
    "bad_logs": f"WITH {fx.LOGS} SELECT count(*) AS n FROM log WHERE user_id % 5 = 0",
    "merge_utilities_with_r2": """SELECT 'set' || (c.c_custkey // 3) AS initial_set, c.c_custkey % 3 AS size, 'cluster' AS base_sampling_type, 'cluster_x' || c.c_custkey AS sampling_type, c.c_custkey::DOUBLE AS utility, s.c_custkey / 10 AS r2
FROM customer c JOIN customer s ON s.c_custkey = c.c_custkey // 3 * 3 WHERE c.c_custkey % 2 = 1 AND c.c_custkey % 3 < 2""",
    "experiment_grid": """SELECT c_name AS dataset, m AS method, 10 + a AS c2, CASE m WHEN 'random' THEN 4 ELSE 8 END::BIGINT AS runs FROM customer, (VALUES ('random'), ('poprisk')) x(m), (VALUES (0.0::DOUBLE), (5.0)) y(a)""",
    "map_layer": f"WITH {fx.GEO} SELECT id, nation = 3 AS in_sample FROM geo",
    "parse_sample_name": """SELECT c_custkey AS k, (c_custkey * 10)::INT AS sample_size, c_custkey::INT AS seed, c_custkey::VARCHAR AS c_0, c_custkey::VARCHAR || '' AS c_1, 'state' AS c_2, 'county' AS c_3,
'urban_based' AS v_0, c_custkey::VARCHAR AS v_1, 'prob' AS v_2, c_custkey::INT AS v_3, 'adm2' AS v_4, (c_custkey + 2)::INT AS v_5, (c_custkey + 1)::INT AS v_6 FROM customer""",
    "run_key": "SELECT c_custkey, 'init/uniform/' || CASE WHEN c_custkey % 2 = 0 THEN 'opt/poprisk/state/budget_100/util_lambda_0.5' ELSE 'random/budget_100' END || '/seed_' || c_custkey AS run_key FROM customer",
}
