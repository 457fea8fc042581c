"""Queries: files written and read again, and tables joined for output."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import sources
from ..operators import prep, selection, spatial
from ..rng import digits_sql
from ..stored import fresh_path
from . import fixtures as fx


def labels(spark, d):
    c, path = fx.table(spark, d, "customer"), fresh_path(spark, "labels")
    balance = F.when(F.col("c_custkey") % 5 == 0, F.lit("NA")).when(F.col("c_custkey") % 7 == 0, F.lit("")).otherwise(F.col("c_acctbal").cast("string"))
    c.select(F.col("c_custkey").alias("ID"), balance.alias("income"), F.lit("x").alias("other"), (F.col("c_custkey") / 4).alias("lat"), (F.col("c_custkey") / 8).alias("lon")).write.option("header", True).csv(path)
    return sources.read_labels(spark, path, ["income"])


def features(spark, d):
    path = fresh_path(spark, "features")
    fx.features(spark, d).select("id", F.col("x").cast("array<float>").alias("x"), (F.col("id").cast("int") / 2).alias("lat"), (F.col("id").cast("int") / 4).alias("lon")).write.parquet(path)
    return sources.read_features(spark, path).select("id", F.size("x").alias("d"), F.col("x")[3].cast("double").alias("x3"), "lat", "lon")


def wide_features(spark, d):
    li = fx.table(spark, d, "lineitem").select(F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("ID"), F.col("l_quantity").alias("f0"), F.col("l_tax").alias("f1"))
    own = sources.read_wide_features(li, "f", 2, "ID")
    return own.select("id", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"))


def split(spark, d):
    path = fresh_path(spark, "split")
    fx.points(spark, d).filter("labeled").select(F.concat(F.lit(" "), "id")).write.text(path)
    return sources.read_split(spark, path)


def assignment(spark, d):
    u, out = fx.points(spark, d).select("id", F.col("region").alias("value")), []
    for fmt in ("parquet", "csv"):
        path = fresh_path(spark, "assignment")
        u.write.option("header", True).format(fmt).save(path)
        out.append(sources.read_assignment(spark, path, fmt).withColumn("fmt", F.lit(fmt)))
    return out[0].unionByName(out[1])


def sample(spark, d):
    path = fresh_path(spark, "sample")
    sources.write_table(fx.points(spark, d).select(F.col("grp").alias("run_id"), "id"), path)
    return sources.read_sample(spark, path, "2-HIGH")


def run_logs(spark, d):
    path = fresh_path(spark, "logs")
    fx.run_logs(spark, d).select("event_type", "text").repartition(4, "event_type").write.partitionBy("event_type").text(path)
    got = sources.read_run_logs(spark, path, "*.txt")
    kind = F.regexp_extract("path", "event_type=(\\w+)/", 1)
    return got.groupBy(kind.alias("event_type")).agg(F.sum(F.regexp_count("text", F.lit("Updated MSE"))).alias("n"))


def status(spark, d):
    """Two episodes, each written twice."""
    path, p = fresh_path(spark, "status"), fx.points(spark, d)
    for episode in (0, 1, 0, 1):
        own = F.when(F.col("labeled") | ((F.col("grp") == "5-LOW") & F.lit(episode == 1)), "labeled").otherwise("unlabeled")
        sources.write_status(p.select("id", own.alias("status")), path, "run", episode)
    return spark.read.parquet(path).groupBy("run_id", "episode", "status").agg(F.count("*").alias("n"))


def scores(spark, d):
    path, c = fresh_path(spark, "scores"), fx.table(spark, d, "customer")
    own = c.select(F.col("c_custkey").alias("seed"), F.col("c_acctbal").cast("double").alias("r2"))
    for part in (0, 1):
        sources.append_scores(own.filter(F.col("seed") % 2 == part), path)
    return sources.read_scores(spark, path, "seed long, r2 double")


def written_results(spark, d):
    path, e = fresh_path(spark, "results"), fx.table(spark, d, "events")
    mart = e.groupBy(F.col("event_type").alias("dataset"), (F.col("user_id") % 3).alias("init_set"), (F.col("user_id") % 2).alias("cost_type")).agg(F.count("*").alias("n"))
    sources.write_results(mart, path, csv=True)
    return spark.read.option("header", True).schema("n long, dataset string, init_set int, cost_type int").csv(path)


def combined(spark, d):
    """Two parts of a mart with columns of their own, the first written again, as one table; and the runs that are done."""
    path, e = fresh_path(spark, "mart"), fx.table(spark, d, "events")
    kinds = ["click", "view"]
    for kind in (*kinds, kinds[0]):
        own = e.filter(F.col("event_type") == kind).groupBy(F.col("event_type").alias("dataset"), (F.col("user_id") % 3).cast("string").alias("init_set"), F.lit("c").alias("cost_type"))
        sources.write_results(own.agg(F.count("*").alias("n"), F.max("user_id").alias(f"top_{kind}")), path)
    got = sources.combined_results(spark, path)
    return got.select("dataset", F.col("init_set").cast("int").alias("init_set"), "n", *[f"top_{k}" for k in kinds])


def runs_to_do(spark, d):
    """Runs whose last status is not written yet."""
    from ..operators.results import skip_done_runs

    path, p = fresh_path(spark, "status"), fx.points(spark, d).select("id", F.lit("labeled").alias("status"), "grp")
    for grp in ("1-URGENT", "2-HIGH"):
        sources.write_status(p.filter(F.col("grp") == grp), path, grp, 1)
    sources.write_status(p.filter("grp = '5-LOW'"), path, "5-LOW", 0)
    grid = fx.points(spark, d).select(F.col("grp").alias("run_id"), F.lit("random").alias("method")).distinct()
    return skip_done_runs(grid, sources.done_runs(spark, path)).select("run_id")


def metric_files(spark, d):
    """Metrics of five seeds, in a file each, read again but for one seed."""
    path, li = fresh_path(spark, "metrics"), fx.table(spark, d, "lineitem")
    own = li.groupBy((F.col("l_suppkey") % 5).alias("seed")).agg(F.avg(F.col("l_tax").cast("double")).alias("r2"), F.max(F.col("l_quantity").cast("double")).alias("mse"), F.lit(None).cast("double").alias("mae"))
    own.select("seed", F.to_json(F.struct("r2", "mse", "mae")).alias("value")).repartition("seed").write.partitionBy("seed").text(path)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for s in range(5):  # the names that the reader knows
        for f in fs.listStatus(at(f"{path}/seed={s}")):
            fs.rename(f.getPath(), at(f"{path}/seed={s}/initial_set_metrics_seed_{s}.json"))
    return sources.read_metric_json(spark, path, ["0", "1", "2", "4"]).select("seed", "metric", F.bround("value", 9).alias("value"))


def admin_by_id(spark, d):
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    admin = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_custkey").cast("string").alias("admin"))
    return prep.attach_admin_by_id(c, admin)


def tiles(spark, d):
    own = fx.geo(spark, d).select("id", "lon", "lat")
    return prep.tiles_with_labels(own, fx.labels_long(spark, d).filter("not isnan(value)"), ["housing", "population"]).select("id", "lon", "lat", "housing", "population")


def located_labels(spark, d):
    c = fx.table(spark, d, "customer")
    own = c.select(F.concat_ws(",", F.col("c_custkey") % 40 + 1, F.col("c_nationkey") + 1).alias("id"), "c_custkey", F.when(F.col("c_custkey") % 9 == 0, -999.0).otherwise(F.col("c_acctbal").cast("double") + 1000).alias("y"))
    return prep.labels_with_grid_location(own, *fx.axes(spark), "population").select("c_custkey", F.bround("y", 9).alias("y"), "lon", "lat")


def unit_values(spark, d):
    return selection.unit_attribute(fx.points(spark, d), "region")


def top(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice").cast("double") / 10_000).alias("v"))
    return selection.top_by(o, "v", 700, "top")


def sorted_places(spark, d):
    own = prep.geo_sort(fx.geo(spark, d))
    return own.select("id", "lat", "lon")


def sort_order(spark, d):
    """Neighbours of the sorted places that are out of order: there must be none."""
    own = prep.geo_sort(fx.geo(spark, d)).select("lat", "lon").withColumn("at", F.monotonically_increasing_id())
    w = Window.orderBy("at")
    before = own.withColumns({"lat0": F.lag("lat").over(w), "lon0": F.lag("lon").over(w)})
    wrong = (F.col("lat0") < F.col("lat")) | ((F.col("lat0") == F.col("lat")) & (F.col("lon0") > F.col("lon")))
    return before.agg(F.count("*").alias("n"), F.sum(F.coalesce(wrong, F.lit(False)).cast("long")).alias("out_of_order"))


def both_splits(spark, d):
    p = fx.points(spark, d).select("id", "unit")
    return prep.concat_splits(p.filter("unit < '5'"), p.filter("unit >= '5'"))


def grid_steps(spark, d):
    """The grid coordinates that lie next to the places, and how many places each has."""
    lon, lat = spatial.make_grid(spark, 6, 640, 0.0, 50.0, 0.0, 25.0)
    own = spatial.nearest_grid_index(fx.geo(spark, d), lon, lat)
    return own.groupBy("i").agg(F.count("*").alias("n"))


def grid_rows(spark, d):
    """As grid_steps, by latitude."""
    lon, lat = spatial.make_grid(spark, 6, 640, 0.0, 50.0, 0.0, 25.0)
    return spatial.nearest_grid_index(fx.geo(spark, d), lon, lat).groupBy("j").agg(F.count("*").alias("n"))


_STEP = "(2 * 156543.03392::DOUBLE / 64 * 320 / (pi() * 6371000 / 180))"
QUERIES = {
    "scan_labels": labels, "scan_features": features, "scan_wide_features": wide_features, "scan_split": split, "scan_assignment": assignment, "scan_sample": sample, "scan_run_logs": run_logs,
    "sink_status": status, "sink_scores": scores, "sink_results": written_results, "attach_admin_by_id": admin_by_id, "tiles_with_labels": tiles, "labels_with_grid_location": located_labels,
    "unit_attribute": unit_values, "top_by": top, "geo_sort": sorted_places, "concat_splits": both_splits, "make_grid": grid_steps,
    "make_grid_latitudes": grid_rows, "geo_sort_order": sort_order, "sink_results_combined": combined, "scan_metric_json": metric_files, "skip_written_runs": runs_to_do,
}
ORACLE_SQL = {
    "make_grid_latitudes": f"""WITH RECURSIVE {fx.GEO}, t(idx, coord) AS (SELECT 1, 25.0::DOUBLE UNION ALL SELECT idx + 1, coord - {_STEP} * cos(radians(coord)) FROM t WHERE coord - {_STEP} * cos(radians(coord)) >= 0),
e AS (SELECT min(coord) AS a, max(coord) AS z, (max(coord) - min(coord)) / (count(*) - 1) / 2 AS half FROM t),
k AS (SELECT id, CASE WHEN any_value(lat) BETWEEN any_value(a) - any_value(half) AND any_value(z) + any_value(half) THEN arg_min(idx, (abs(coord - lat), coord)) END AS j FROM geo, t, e GROUP BY id) SELECT j, count(*) AS n FROM k GROUP BY j""",
    "geo_sort_order": f"WITH {fx.GEO} SELECT count(*) AS n, 0::BIGINT AS out_of_order FROM geo",
    "sink_results_combined": """SELECT event_type AS dataset, (user_id % 3)::INT AS init_set, count(*) AS n, max(user_id) FILTER (event_type = 'click') AS top_click, max(user_id) FILTER (event_type = 'view') AS top_view
FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type, user_id % 3""",
    "scan_metric_json": """WITH s AS (SELECT (l_suppkey % 5)::VARCHAR AS seed, avg(l_tax::DOUBLE) AS r2, max(l_quantity::DOUBLE) AS mse FROM lineitem GROUP BY ALL)
SELECT seed, 'r2' AS metric, round_even(r2, 9) AS value FROM s WHERE seed <> '3' UNION ALL SELECT seed, 'mse', mse FROM s WHERE seed <> '3'""",
    "skip_written_runs": f"WITH {fx.POINTS} SELECT DISTINCT grp AS run_id FROM points WHERE grp NOT IN ('1-URGENT', '2-HIGH')",
    "scan_labels": "SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 5 > 0 AND c_custkey % 7 > 0 THEN c_acctbal::DOUBLE END AS income, c_custkey / 4 AS lat, c_custkey / 8 AS lon FROM customer",
    "scan_features": "SELECT vec_id::VARCHAR AS id, len(embedding)::INT AS d, embedding[4]::DOUBLE AS x3, vec_id / 2 AS lat, vec_id / 4 AS lon FROM embeddings",
    "scan_wide_features": "SELECT concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS id, l_quantity::DOUBLE AS x0, l_tax::DOUBLE AS x1 FROM lineitem",
    "scan_split": f"WITH {fx.POINTS} SELECT id FROM points WHERE labeled",
    "scan_assignment": f"WITH {fx.POINTS} SELECT id, region AS value, unnest(['parquet', 'csv']) AS fmt FROM points",
    "scan_sample": f"WITH {fx.POINTS} SELECT grp AS run_id, id FROM points WHERE grp = '2-HIGH'",
    "scan_run_logs": f"WITH {fx.LOGS} SELECT event_type, count(*) AS n FROM log GROUP BY event_type",
    "sink_status": f"""WITH {fx.POINTS}, s AS (SELECT episode, CASE WHEN labeled OR (grp = '5-LOW' AND episode = 1) THEN 'labeled' ELSE 'unlabeled' END AS status FROM points, (VALUES (0), (1)) e(episode))
SELECT 'run' AS run_id, episode, status, count(*) AS n FROM s GROUP BY ALL""",
    "sink_scores": "SELECT c_custkey AS seed, c_acctbal::DOUBLE AS r2 FROM customer",
    "sink_results": "SELECT event_type AS dataset, (user_id % 3)::INT AS init_set, (user_id % 2)::INT AS cost_type, count(*) AS n FROM events GROUP BY ALL",
    "attach_admin_by_id": "SELECT c_custkey AS id, c_nationkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN c_custkey::VARCHAR END AS admin FROM customer",
    "tiles_with_labels": f"WITH {fx.GEO}, {fx.LABELS} SELECT geo.id, lon, lat, value AS housing, value AS population FROM geo LEFT JOIN (SELECT * FROM labels WHERE NOT isnan(value)) l ON geo.id = l.id",
    "labels_with_grid_location": f"""WITH {fx.AXES} SELECT c_custkey, round_even(ln(c_acctbal::DOUBLE + 1001), 9) AS y, x.coord AS lon, z.coord AS lat FROM customer LEFT JOIN lon_axis x ON x.idx = c_custkey % 40 + 1
LEFT JOIN lat_axis z ON z.idx = c_nationkey + 1 WHERE c_custkey % 9 <> 0""",
    "unit_attribute": f"WITH {fx.POINTS} SELECT unit, min(region) AS value FROM points GROUP BY unit",
    "top_by": f"SELECT o_orderkey AS id, floor(o_totalprice::DOUBLE / 10000)::BIGINT AS v FROM orders ORDER BY v, {digits_sql('top', 'o_orderkey')}, id LIMIT 700",
    "geo_sort": f"WITH {fx.GEO} SELECT id, lat, lon FROM geo",
    "concat_splits": f"WITH {fx.POINTS} SELECT id, unit FROM points",
    "make_grid": f"""WITH {fx.GEO}, e AS (SELECT {_STEP} AS step, floor(50 / {_STEP}) AS n), k AS (SELECT floor(lon / step) AS a, lon / step - floor(lon / step) AS r, n, lon / step AS pos FROM geo, e)
SELECT CASE WHEN pos > n + 0.5 THEN NULL WHEN a >= n THEN n + 1 WHEN r <= 0.5 THEN a + 1 ELSE a + 2 END::INT AS i, count(*) AS n FROM k GROUP BY 1""",
}
