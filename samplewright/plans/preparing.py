"""Queries: population preparation, scalar functions, spatial joins, aggregates, groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, keys, labels
from ..operators import aggregates, groups, prep, spatial
from . import fixtures as fx

# cleaning and transforms


def drop_missing(spark, d):
    own = fx.labels_long(spark, d).filter("label = 'elevation'")
    return prep.drop_missing_label(own, "value").select("id", "value")


def drop_missing_rows(spark, d):
    own = fx.labels_long(spark, d).filter("label = 'elevation'").withColumns({"x": F.array(F.col("value"), F.lit(1.0)), "lon": F.lit(1.0), "lat": F.lit(2.0)})
    return labels.drop_missing_rows(own, "value", mode="all").select("id")


def transforms(spark, d):
    own = labels.drop_missing_label(fx.labels_long(spark, d), "value")
    y = F.coalesce(*[F.when(F.col("label") == name, labels.transform_label(F.col("value"), name)) for name in ("housing", "elevation", "population")])
    return own.select("id", "label", F.bround(y, 9).alias("y"))


def trimmed(spark, d):
    own = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("y"))
    return prep.trim_upper(own, "y", 99.9).select("l_orderkey", "l_linenumber")


def trimmed_age(spark, d):
    own = fx.table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("double").alias("y"))
    return prep.trim_upper(own, "y", 99.9, year=2015).groupBy("y").agg(F.count("*").alias("n"))


def clipped(spark, d):
    spec = labels.label_spec(spark).filter("label = 'treecover'")
    own = fx.table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("v"))
    return own.join(F.broadcast(spec)).select("c_custkey", labels.clip(F.col("v"), F.col("lo"), F.col("hi")).alias("y"), labels.clip(F.col("v"), 0.0, None).alias("open"))


def invalid_ids(spark, d):
    return prep.drop_invalid_ids(fx.table(spark, d, "customer").select(F.concat_ws(",", "c_custkey", "c_nationkey").alias("id")), ["1,15", "2,13", "10,5"])


def outcomes(spark, d):
    own = fx.labels_long(spark, d).filter("label = 'population'").withColumnRenamed("value", "population")
    out = labels.clean_outcome(own.filter("population is not null and not isnan(population) and population < 1e300"), "population")
    return out.select("id", F.bround("log_population", 9).alias("log_population"))


def multi_label(spark, d):
    names = ["housing", "elevation", "population"]
    wide = prep.multi_label_table(fx.labels_long(spark, d), names)
    return wide.select("id", *[F.bround(n, 9).alias(n) for n in names])


# joins and sets


def attach_labels(spark, d):
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("y"))
    o = fx.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("x"))
    return prep.attach_labels(c, o)


def three_way(spark, d):
    c, n, r = fx.table(spark, d, "customer"), fx.table(spark, d, "nation"), fx.table(spark, d, "nation")
    f = c.select(F.col("c_nationkey").alias("k"), "c_custkey")
    lab = n.select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey").cast("double")).alias("y"))
    return prep.join_features_labels_geometry(f, lab, r.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("geometry")), "k", "y")


def admin_names(spark, d):
    c = fx.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("state_id"), (F.col("c_custkey") % 7).alias("district_id"))
    states = fx.table(spark, d, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("state_id"), F.col("n_name").alias("s_name"))
    districts = states.select("state_id", F.explode(F.array(*[F.lit(i).cast("long") for i in range(5)])).alias("district_id")).withColumn("d_name", F.concat_ws("-", "state_id", "district_id"))
    return prep.attach_admin_names(c, states, districts)


def known_ids(spark, d):
    pts = fx.points(spark, d)
    sample = pts.filter("grp = '1-URGENT'").select("id").unionByName(spark.range(3).select(F.concat(F.lit("none"), "id").alias("id")))
    return prep.ids_to_rows(pts, sample.unionByName(sample)).select("id", "unit")


def status(spark, d):
    pts = fx.points(spark, d)
    return prep.make_status(pts, pts.filter("labeled").select("id"), pts.filter("not labeled and grp = '5-LOW'").select("id"))


def scored(spark, d):
    pred = fx.ridge_rows(spark, d).select("id", "y", (F.col("x")[0] * 3).alias("pred"))
    kept = fx.ridge_rows(spark, d).filter(F.col("id").endswith("|1")).select("id")
    return aggregates.regression_metrics(prep.restrict_scored_ids(pred, kept)).select(*[F.bround(c, 6).alias(c) for c in ("r2", "mse", "rmse", "mae")])


def sets(spark, d):
    pts = fx.points(spark, d)
    rest = prep.minus(pts.select("unit").distinct(), pts.filter("labeled").select("unit"), "unit")
    tagged = prep.union_tagged({"rest": rest, "labeled": prep.union_distinct(pts.filter("labeled").select("unit"), pts.filter("labeled").select("unit"))})
    return prep.union_outer(tagged, fx.table(spark, d, "nation").select(F.col("n_name").alias("nation")))


def firsts(spark, d):
    return prep.first_row_per_group(fx.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("double").alias("price")), ["o_custkey"], "o_orderkey")


# scalar functions


def key_functions(spark, d):
    c = fx.table(spark, d, "customer")
    return c.select(
        "c_custkey", keys.composite_key(F.col("c_nationkey"), F.col("c_mktsegment"), F.lit(None)).alias("composite"),
        keys.county_key(F.col("c_mktsegment"), F.col("c_nationkey"), F.col("c_custkey") % 200).alias("county"),
        keys.tile_id(F.concat(F.lit("tile_"), F.col("c_custkey"), F.lit(".tif"))).alias("tile"),
        keys.split_shrid(F.concat_ws("-", F.lit("11"), "c_nationkey", F.col("c_custkey") % 9, F.lit("x")))[2].alias("district"),
        keys.normalize_admin(F.concat(F.lit("  "), F.element_at(F.array(*[F.lit(x) for x in ("Tandjouaré", "BINAH", "Centre", "Lomé ", "Mô")]), (F.col("c_custkey") % 5 + 1).cast("int")))).alias("admin"),
        keys.format_cell(F.when(F.col("c_custkey") % 4 != 0, (F.col("c_custkey") % 100) / 8), F.lit(0.25)).alias("cell"),
    )


def geo_functions(spark, d):
    g = fx.geo(spark, d)
    lon, lat = F.col("lon") * 7 - 180, F.col("lat") * 7 - 90
    return g.select("id", geo.world_region(lon, lat).alias("region"), geo.world_grid_cell(lon, lat, 36, 18).alias("cell"), F.bround(geo.meters_per_pixel(F.col("lat"), 16), 6).alias("mpp"), F.bround(geo.haversine(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0)), 2).alias("metres"))


def spec(spark, d):
    own = labels.label_spec(spark).select("label", "lo", "hi")
    return fx.labels_long(spark, d).groupBy("label").agg(F.count("*").alias("n")).join(own, "label")


def acs_spec(spark, d):
    """The spec of every survey label, with the number of parts that a remainder gives it."""
    own = labels.label_spec(spark).filter("colname = 'Val'").select("label", "lo", "hi", "lambda_from", "lambda_to", "n_lambda")
    parts = fx.table(spark, d, "part").groupBy((F.col("p_partkey") % 12).alias("k")).agg(F.count("*").alias("n"))
    names = spark.createDataFrame(list(enumerate(ACS)), "k int, label string")
    return parts.join(names, "k").join(own, "label").drop("k")


def acs_values(spark, d):
    """Ages of orders by the rule of B25035, retail prices by that of B25001."""
    o = fx.table(spark, d, "orders").select(F.year("o_orderdate").cast("double").alias("y"))
    p = fx.table(spark, d, "part").select(F.col("p_retailprice").cast("double").alias("y"))
    got = [prep.transformed(own, "y", label).groupBy(F.bround("y", 9).alias("y")).agg(F.count("*").alias("n")).withColumn("label", F.lit(label)) for own, label in ((o, "B25035"), (p, "B25001"))]
    return got[0].unionByName(got[1])


# spatial


def within(spark, d):
    return spatial.points_within_polygons(fx.geo(spark, d), fx.polygons(spark, d, without=12), 2.0).select("id", "polygon")


def nearest(spark, d):
    return spatial.polygon_or_nearest(fx.geo(spark, d), fx.polygons(spark, d, without=12), 2.0).select("id", "polygon")


def land(spark, d):
    return spatial.land_filter(fx.geo(spark, d), fx.polygons(spark, d).filter("polygon % 2 = 0"), 2.0).select("id")


def grid_index(spark, d):
    return spatial.nearest_grid_index(fx.geo(spark, d), *fx.axes(spark)).select("id", "i", "j")


def centroids(spark, d):
    ids = fx.table(spark, d, "customer").select(F.concat_ws(",", F.col("c_custkey") % 40 + 1, F.col("c_nationkey") + 1).alias("id"), "c_custkey")
    return spatial.grid_centroid(ids, *fx.axes(spark))


def tile_lookup(spark, d):
    px = fx.geo(spark, d)
    raster = fx.pixels(spark, d).groupBy("row", "col").agg(F.min("class").alias("class"))
    return spatial.tile_class_lookup(px, raster, 10.0, 20.0, 1.5).select("id", "class")


def located_tiles(spark, d):
    places = fx.geo(spark, d)
    tiles = places.select(F.concat(F.lit("tile_"), "id", F.lit(".tif")).alias("name"))
    return spatial.attach_tile_location(tiles, places, *fx.axes(spark)).select("id", "grid_id")


def tile_rings(spark, d):
    ring = geo.tile_vertices(F.col("lon"), F.col("lat"), 14, 640)
    return fx.geo(spark, d).select("id", F.bround(ring[0]["x"], 6).alias("x"), F.bround(ring[0]["y"], 6).alias("y"), F.bround(geo.equal_area_centroid(F.array(ring))["lon"], 6).alias("clon"))


# aggregates


def division_counts(spark, d):
    return aggregates.counts_per_division(fx.points(spark, d), "unit")


def histogram(spark, d):
    return aggregates.division_histogram(fx.points(spark, d), "unit", 10)


def nesting(spark, d):
    own = fx.table(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("part"), (F.col("l_suppkey") % 3).alias("supp")).filter("part <> 7 or supp = 1")
    return aggregates.nesting_violations(own, "part", "supp")


def shares(spark, d):
    return aggregates.class_shares(fx.pixels(spark, d)).select("tile_id", *[F.bround(F.col(f"c{c}").cast("double"), 5).alias(f"c{c}") for c in aggregates.CLASSES])


def population_shares(spark, d):
    return aggregates.group_population_shares(fx.points(spark, d), ["5-LOW"]).select("grp", "n", F.bround("share", 9).alias("share"))


def metrics(spark, d):
    own = fx.ridge_rows(spark, d).withColumn("pred", F.col("x")[0] * 3 + 20)
    return aggregates.regression_metrics(own, ["run_id"]).select("run_id", *[F.bround(c, 6).alias(c) for c in ("r2", "mse", "rmse", "mae")])


def spearman(spark, d):
    own = fx.table(spark, d, "orders").select("o_orderpriority", F.col("o_custkey").alias("u"), F.floor(F.col("o_totalprice").cast("double") / 1000).alias("v"))
    return aggregates.spearman_by_type(own, "o_orderpriority", "u", "v").select("type", F.bround("rho", 9).alias("rho"))


def boxplot(spark, d):
    own = fx.table(spark, d, "orders").select("o_orderpriority", F.col("o_totalprice").cast("double").alias("v"))
    return aggregates.boxplot_stats(own, "o_orderpriority", "v").select("o_orderpriority", *[F.bround(c, 4).alias(c) for c in ("q1", "median", "q3", "low", "high")], "outliers")


def blocks(spark, d):
    return aggregates.block_mean(fx.pixels(spark, d), 3)


def image_r2(spark, d):
    return aggregates.across_image_r2(fx.pixels(spark, d), [1, 2, 4], demean=True).select("width", F.bround("r2", 9).alias("r2"))


# groups


def admin_groups(spark, d):
    return groups.assign_admin_groups(fx.points(spark, d), ["region", "grp"])


def kmeans(spark, d):
    return groups.kmeans_groups(fx.features(spark, d), 6)


def kmeans_nearest(spark, d):
    own = fx.features(spark, d)
    return groups.nearest_centres(own, *groups.kmeans_fit(own, 6))


def landcover(spark, d):
    return groups.landcover_groups(fx.pixels(spark, d))


def landcover_nearest(spark, d):
    """Groups of the tiles' class shares: as many tiles as have any, each with its nearest centre."""
    own = groups.landcover_features(fx.pixels(spark, d))
    got = groups.nearest_centres(own, *groups.kmeans_fit(own, 4))
    return got.select("rows", (F.col("groups") <= 4).alias("few"), "nearest")


#: Survey labels, in the order in which the query deals parts to them.
ACS = ("B08303", "B15003", "B19013", "B19301", "C17002", "B22010", "B25001", "B25002", "B25035", "B25017", "B25077", "B25071")
METRIC_SQL = "round_even(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)), 6) AS r2, round_even(avg((y - pred) * (y - pred)), 6) AS mse, round_even(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse, round_even(avg(abs(y - pred)), 6) AS mae"
TRANSFORM = "CASE label WHEN 'housing' THEN ln(value) WHEN 'elevation' THEN value ELSE ln(value + 1) END"
INSIDE = "lon > x AND lon < x + 10 AND lat > y AND lat < y + 5"


def geodesic_sql(pairs: str, rounds: int = 12) -> str:
    """CTEs that end in geodesic(id, polygon, metres) on the WGS84 ellipsoid for pairs (id, polygon, lon, lat, px, py)."""
    f, a = 1 / 298.257223563, 6378137.0
    b = a * (1 - f)
    turn = "sqrt(pow(c2 * sin(lam), 2) + pow(c1 * s2 - s1 * c2 * cos(lam), 2))"
    one = f"SELECT *, {turn} AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs FROM vin"
    two = f"SELECT *, atan2(ss, cs) AS sg, CASE WHEN ss > 0 THEN c1 * c2 * sin(lam) / ss ELSE 0 END AS sa FROM ({one})"
    three = f"SELECT *, 1 - sa * sa AS ca, CASE WHEN 1 - sa * sa > 1e-15 THEN cs - 2 * s1 * s2 / (1 - sa * sa) ELSE 0 END AS m FROM ({two})"
    four = f"SELECT *, {f!r} / 16 * ca * (4 + {f!r} * (4 - 3 * ca)) AS c, ca * {(a * a - b * b) / (b * b)!r} AS k FROM ({three})"
    big = "(1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k))))"
    small = "(k / 1024 * (256 + k * (-128 + k * (74 - 47 * k))))"
    off = f"{small} * ss * (m + {small} / 4 * (cs * (2 * m * m - 1) - {small} / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3)))"
    return f"""reduced AS (SELECT id, polygon, radians(px - lon) AS l, atan({1 - f!r} * tan(radians(lat))) AS u1, atan({1 - f!r} * tan(radians(py))) AS u2 FROM {pairs}),
vin AS (SELECT id, polygon, 0 AS step, l AS lam, l, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2 FROM reduced
UNION ALL SELECT id, polygon, step + 1, l + (1 - c) * {f!r} * sa * (sg + c * ss * (m + c * cs * (2 * m * m - 1))), l, s1, c1, s2, c2 FROM ({four}) WHERE step < {rounds}),
geodesic AS (SELECT id, polygon, {b!r} * {big} * (sg - {off}) AS metres FROM ({four}) WHERE step = {rounds})"""


MPP = "156543.03392::DOUBLE * cos(radians(lat)) / 16384 * 320 / (pi() * 6371000 / 180)"


def _axis(axis: str, v: str) -> str:
    return f"(SELECT CASE WHEN g.{v} < (SELECT min(coord) - (max(coord) - min(coord)) / (count(*) - 1) / 2 FROM {axis}) OR g.{v} > (SELECT max(coord) + (max(coord) - min(coord)) / (count(*) - 1) / 2 FROM {axis}) THEN NULL ELSE arg_min(idx, abs(coord - g.{v})) END FROM {axis})"


_world = """CASE WHEN x >= -180 AND x < -31.5 AND y >= 12.5 THEN 0 WHEN x >= -31.5 AND x < 60 AND y >= 12.5 THEN 1 WHEN x >= 60 AND y >= 5.5 THEN 2
WHEN x >= -180 AND x < -31.5 THEN 3 WHEN x >= -31.5 AND x < 60 THEN 4 WHEN x >= 60 THEN 5 ELSE 0 END"""
_state = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in keys.STATES.items()) + "}"

QUERIES = {
    "drop_missing_label": drop_missing, "drop_missing_rows": drop_missing_rows, "transform_label": transforms, "trim_upper": trimmed, "trim_upper_age": trimmed_age, "clip": clipped, "drop_invalid_ids": invalid_ids,
    "clean_outcome": outcomes, "multi_label_table": multi_label, "attach_labels": attach_labels, "join_features_labels_geometry": three_way, "attach_admin_names": admin_names, "ids_to_rows": known_ids,
    "make_status": status, "restrict_scored_ids": scored, "set_operations": sets, "first_row_per_group": firsts, "key_functions": key_functions, "geo_functions": geo_functions, "label_spec": spec,
    "points_within_polygons": within, "nearest_polygon": nearest, "land_filter": land, "nearest_grid_index": grid_index, "grid_centroid": centroids, "tile_class_lookup": tile_lookup,
    "attach_tile_location": located_tiles, "tile_vertices": tile_rings, "counts_per_division": division_counts, "division_histogram": histogram, "nesting_violations": nesting, "class_shares": shares,
    "group_population_shares": population_shares, "regression_metrics": metrics, "spearman_by_type": spearman, "boxplot_stats": boxplot, "block_mean": blocks, "across_image_r2": image_r2,
    "assign_admin_groups": admin_groups, "kmeans_groups": kmeans, "landcover_groups": landcover, "kmeans_groups_nearest": kmeans_nearest, "landcover_groups_nearest": landcover_nearest, "label_spec_acs": acs_spec, "transform_acs": acs_values,
}

ORACLE_SQL = {
    "kmeans_groups_nearest": "SELECT count(*) AS rows, 6::BIGINT AS groups, true AS nearest FROM embeddings",
    "landcover_groups_nearest": f"WITH {fx.PIXELS} SELECT count(DISTINCT tile_id) AS rows, true AS few, true AS nearest FROM pixels WHERE class IN ({', '.join(map(str, aggregates.CLASSES))})",
    "label_spec_acs": f"""SELECT label, lo, hi, f AS lambda_from, t AS lambda_to, n_lambda, count(*) AS n FROM part JOIN (VALUES
(0, 'B08303', 0.0::DOUBLE, NULL::DOUBLE, -3.0::DOUBLE, 3.0::DOUBLE, 5), (1, 'B15003', 0, 100, -3, 3, 5), (2, 'B19013', 0, NULL, -3, 3, 5), (3, 'B19301', 0, NULL, -3, 3, 5), (4, 'C17002', 0, 100, -3, 3, 5), (5, 'B22010', 0, 100, -3, 3, 5),
(6, 'B25001', 0, 2641, -3, 3, 5), (7, 'B25002', 0, 100, -3, 3, 5), (8, 'B25035', 0, 75.3, -1, 3, 5), (9, 'B25017', 0, NULL, -3, 3, 5), (10, 'B25077', 0, NULL, -3, 3, 5), (11, 'B25071', 0, 100, 2, 5, 4)) v(k, label, lo, hi, f, t, n_lambda) ON p_partkey % 12 = k GROUP BY ALL""",
    "transform_acs": """WITH a AS (SELECT (2015 - year(o_orderdate))::DOUBLE AS y, 'B25035' AS label FROM orders UNION ALL SELECT p_retailprice::DOUBLE, 'B25001' FROM part), e AS (SELECT label, quantile_cont(y, 0.999) AS edge FROM a GROUP BY label)
SELECT round_even(ln(y + 1), 9) AS y, label, count(*) AS n FROM a JOIN e USING (label) WHERE y < edge GROUP BY ALL""",
    "drop_missing_label": f"WITH {fx.LABELS} SELECT id, value FROM clean",
    "drop_missing_rows": f"WITH {fx.LABELS} SELECT id FROM clean",
    "transform_label": f"WITH {fx.LABELS}, l AS (SELECT id, value, unnest(['housing', 'elevation', 'population']) AS label FROM clean) SELECT id, label, round_even({TRANSFORM}, 9) AS y FROM l",
    "trim_upper": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice::DOUBLE < (SELECT quantile_cont(l_extendedprice::DOUBLE, 0.999) FROM lineitem)",
    "trim_upper_age": "WITH a AS (SELECT (2015 - year(o_orderdate))::DOUBLE AS y FROM orders) SELECT y, count(*) AS n FROM a WHERE y < (SELECT quantile_cont(y, 0.999) FROM a) GROUP BY y",
    "clip": "SELECT c_custkey, least(greatest(c_acctbal::DOUBLE, 0), 100) AS y, greatest(c_acctbal::DOUBLE, 0) AS open FROM customer",
    "drop_invalid_ids": "SELECT c_custkey || ',' || c_nationkey AS id FROM customer WHERE c_custkey || ',' || c_nationkey NOT IN ('1,15', '2,13', '10,5')",
    "clean_outcome": f"WITH {fx.LABELS} SELECT id, round_even(ln(value + 1), 9) AS log_population FROM clean",
    "multi_label_table": f"WITH {fx.LABELS} SELECT id, round_even(ln(value), 9) AS housing, round_even(value, 9) AS elevation, round_even(ln(value + 1), 9) AS population FROM clean",
    "attach_labels": "SELECT c_custkey AS id, c_acctbal::DOUBLE AS y, x FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS x FROM orders GROUP BY 1) ON c_custkey = o_custkey",
    "join_features_labels_geometry": "SELECT c_nationkey AS k, c_custkey, n_nationkey::DOUBLE AS y, n_name AS geometry FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 3 <> 0",
    "attach_admin_names": "SELECT c_custkey, c_nationkey AS state_id, c_custkey % 7 AS district_id, n_name AS s_name, CASE WHEN c_nationkey < 20 AND c_custkey % 7 < 5 THEN c_nationkey || '-' || c_custkey % 7 END AS d_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20",
    "ids_to_rows": f"WITH {fx.POINTS} SELECT id, unit FROM points WHERE grp = '1-URGENT'",
    "make_status": f"WITH {fx.POINTS} SELECT id, CASE WHEN labeled THEN 'labeled' WHEN grp = '5-LOW' THEN 'val' ELSE 'unlabeled' END AS status FROM points",
    "restrict_scored_ids": f"WITH {fx.RIDGE}, p AS (SELECT y, q * 3 AS pred FROM ridge_y WHERE id LIKE '%|1') SELECT {METRIC_SQL} FROM p",
    "set_operations": f"""WITH {fx.POINTS} SELECT DISTINCT unit, 'rest' AS sampling_type, NULL AS nation FROM points WHERE unit NOT IN (SELECT unit FROM points WHERE labeled)
UNION ALL SELECT DISTINCT unit, 'labeled', NULL FROM points WHERE labeled UNION ALL SELECT NULL, NULL, n_name FROM nation""",
    "first_row_per_group": "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice::DOUBLE, o_orderkey) AS price FROM orders GROUP BY 1",
    "key_functions": f"""SELECT c_custkey, c_nationkey || '_' || c_mktsegment || '_None' AS composite,
c_mktsegment || '_' || lpad((c_custkey % 200)::VARCHAR, 3, '0') || '_' || coalesce({_state}[lpad(c_nationkey::VARCHAR, 2, '0')], 'None') || '_' || lpad(c_nationkey::VARCHAR, 2, '0') AS county,
c_custkey::VARCHAR AS tile, c_nationkey || '-' || c_custkey % 9 AS district, ['tandjoare', 'bimah', 'centrale', 'lome', 'plaine du mo'][c_custkey % 5 + 1] AS admin,
CASE WHEN c_custkey % 4 = 0 THEN '--' ELSE printf('%.2f', floor((c_custkey % 100) / 8 * 100 + 0.5) / 100) || ' ± 0.25' END AS cell FROM customer""",
    "geo_functions": f"""WITH {fx.GEO}, w AS (SELECT *, lon * 7 - 180 AS x, lat * 7 - 90 AS y FROM geo)
SELECT id, {_world} AS region, CASE WHEN y <= 90 AND y > -90 AND x >= -180 AND x < 180 THEN (floor((90 - y) / 10) * 36 + floor((x + 180) / 10))::BIGINT ELSE 9999 END AS cell,
round_even(156543.03392::DOUBLE * cos(radians(lat)) / 65536, 6) AS mpp,
round_even(2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin((radians(10) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * pow(sin(radians(20 - lon) / 2), 2))), 2) AS metres FROM w""",
    "label_spec": "SELECT label, count(*) AS n, lo, hi FROM part, (VALUES ('housing', 10.0::DOUBLE, 13421.0::DOUBLE), ('elevation', -86.0, 4418.0), ('population', 0.0, 30000.0)) v(label, lo, hi) GROUP BY label, lo, hi",
    "points_within_polygons": f"WITH {fx.GEO}, {fx.POLYGONS} SELECT id, (SELECT min(polygon) FROM polygons WHERE polygon <> 12 AND {INSIDE}) AS polygon FROM geo",
    "nearest_polygon": f"""WITH RECURSIVE {fx.GEO}, {fx.POLYGONS}, pair AS (SELECT id, polygon, lon, lat, least(greatest(lon, x), x + 10) AS px, least(greatest(lat, y), y + 5) AS py FROM geo, polygons WHERE polygon <> 12),
close AS (SELECT *, abs(px - lon) <= 0.5 AND abs(py - lat) <= 0.5 AS near FROM pair QUALIFY near OR NOT bool_or(near) OVER (PARTITION BY id)), {geodesic_sql('close')}
SELECT id, arg_min(polygon, (CASE WHEN metres > 1e-3 THEN metres ELSE 0 END, polygon)) AS polygon FROM geodesic GROUP BY id""",
    "land_filter": f"WITH {fx.GEO}, {fx.POLYGONS} SELECT id FROM geo WHERE EXISTS (SELECT 1 FROM polygons WHERE polygon % 2 = 0 AND {INSIDE})",
    "nearest_grid_index": f"WITH {fx.GEO}, {fx.AXES} SELECT id, {_axis('lon_axis', 'lon')} AS i, {_axis('lat_axis', 'lat')} AS j FROM geo g",
    "grid_centroid": f"WITH {fx.AXES}, c AS (SELECT c_custkey, c_custkey % 40 + 1 AS i, c_nationkey + 1 AS j FROM customer) SELECT i || ',' || j AS id, c_custkey, x.coord AS lon, y.coord AS lat FROM c LEFT JOIN lon_axis x ON x.idx = i LEFT JOIN lat_axis y ON y.idx = j",
    "tile_class_lookup": f"WITH {fx.GEO}, {fx.PIXELS}, r AS (SELECT row, col, min(class) AS class FROM pixels GROUP BY ALL) SELECT id, class FROM geo LEFT JOIN r ON row = floor((20 - lat) / 1.5) AND col = floor((lon - 10) / 1.5)",
    "attach_tile_location": f"WITH {fx.GEO}, {fx.AXES}, ij AS (SELECT id, {_axis('lon_axis', 'lon')} AS i, {_axis('lat_axis', 'lat')} AS j FROM geo g) SELECT id, i || ',' || j AS grid_id FROM ij",
    "tile_vertices": f"WITH {fx.GEO} SELECT id, round_even(lon - {MPP} / cos(radians(lat)), 6) AS x, round_even(lat + {MPP}, 6) AS y, round_even(lon, 6) AS clon FROM geo",
    "counts_per_division": f"WITH {fx.POINTS}, n AS (SELECT count(*) AS n FROM points GROUP BY unit) SELECT avg(n) AS mean, quantile_cont(n, 0.5) AS median, min(n) AS min, max(n) AS max FROM n",
    "division_histogram": f"WITH {fx.POINTS}, n AS (SELECT count(*) AS n FROM points GROUP BY unit), e AS (SELECT min(n) AS lo, max(n) AS hi FROM n) SELECT least(floor((n - lo) / ((hi - lo) / 10)), 9)::BIGINT AS bin, count(*) AS divisions FROM n, e GROUP BY 1",
    "nesting_violations": "SELECT l_partkey % 50 AS child, count(DISTINCT l_suppkey % 3) AS parents FROM lineitem WHERE l_partkey % 50 <> 7 OR l_suppkey % 3 = 1 GROUP BY 1 HAVING parents > 1",
    "class_shares": f"WITH {fx.PIXELS}, t AS (SELECT tile_id, sum((class NOT IN (0, 99))::INT) AS n, " + ", ".join(f"sum((class = {c})::INT) AS n{c}" for c in aggregates.CLASSES) + " FROM pixels GROUP BY 1) SELECT tile_id, " + ", ".join(f"round_even((n{c} / n)::FLOAT::DOUBLE, 5) AS c{c}" for c in aggregates.CLASSES) + " FROM t WHERE n > 0",
    "group_population_shares": f"WITH {fx.POINTS} SELECT grp, count(*) AS n, round_even(count(*) / sum(count(*)) OVER (), 9) AS share FROM points WHERE grp <> '5-LOW' GROUP BY grp",
    "regression_metrics": f"WITH {fx.RIDGE}, p AS (SELECT run_id, y, q * 3 + 20 AS pred FROM ridge_y) SELECT run_id, {METRIC_SQL} FROM p GROUP BY run_id",
    "spearman_by_type": """WITH o AS (SELECT unnest([o_orderpriority, 'all']) AS type, o_custkey AS u, floor(o_totalprice::DOUBLE / 1000) AS v FROM orders),
r AS (SELECT type, rank() OVER (PARTITION BY type ORDER BY u) + (count(*) OVER (PARTITION BY type, u) - 1) / 2 AS ru, rank() OVER (PARTITION BY type ORDER BY v) + (count(*) OVER (PARTITION BY type, v) - 1) / 2 AS rv FROM o)
SELECT type, round_even(corr(ru, rv), 9) AS rho FROM r GROUP BY type""",
    "boxplot_stats": """WITH o AS (SELECT o_orderpriority, o_totalprice::DOUBLE AS v FROM orders), q AS (SELECT o_orderpriority AS p, quantile_cont(v, [0.25, 0.5, 0.75]) AS q FROM o GROUP BY 1)
SELECT o_orderpriority, round_even(any_value(q[1]), 4) AS q1, round_even(any_value(q[2]), 4) AS median, round_even(any_value(q[3]), 4) AS q3, round_even(min(v) FILTER (v >= q[1] - 1.5 * (q[3] - q[1])), 4) AS low,
round_even(max(v) FILTER (v <= q[3] + 1.5 * (q[3] - q[1])), 4) AS high, count(*) FILTER (v < q[1] - 1.5 * (q[3] - q[1]) OR v > q[3] + 1.5 * (q[3] - q[1])) AS outliers FROM o JOIN q ON o_orderpriority = p GROUP BY o_orderpriority""",
    "block_mean": f"WITH {fx.PIXELS} SELECT tile_id, row // 3 AS row, col // 3 AS col, avg(truth) AS truth, avg(pred) AS pred FROM pixels WHERE row < 6 AND col < 6 GROUP BY 1, 2, 3",
    "across_image_r2": f"""WITH {fx.PIXELS}, b AS (SELECT w, tile_id, row // w AS r, col // w AS c, avg(truth) AS t, avg(pred) AS p FROM pixels, (VALUES (1), (2), (4)) v(w) GROUP BY ALL),
m AS (SELECT w, t - avg(t) OVER (PARTITION BY w, tile_id) AS y, p - avg(p) OVER (PARTITION BY w, tile_id) AS pred FROM b)
SELECT w AS width, round_even(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)), 9) AS r2 FROM m GROUP BY w""",
    "assign_admin_groups": f"WITH {fx.POINTS} SELECT id, region || '_' || grp AS grp FROM points",
}
