"""The library's tables built from the driver's, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import CLASSES
from ..rng import uniform, uniform_sql

#: The land-cover classes and two codes that are none.
CODES = ",".join(map(str, [*CLASSES, 0, 99]))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    """Orders as points, customers as units, nations as regions, priorities as groups."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    own = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    id_ = F.col("o_orderkey").cast("string")
    return own.select(
        id_.alias("id"), F.col("o_custkey").cast("string").alias("unit"), F.col("c_nationkey").cast("string").alias("region"), F.col("o_orderpriority").alias("grp"),
        ((F.col("n_regionkey") == 0) & (uniform("lab", id_) < 0.1)).alias("labeled"),
    )


POINTS = f"""points AS (
  SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS unit, c_nationkey::VARCHAR AS region, o_orderpriority AS grp,
         n_regionkey = 0 AND {uniform_sql('lab', 'o_orderkey')} < 0.1 AS labeled
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

UNITS = """units AS (SELECT unit, min(region) AS region, count(*) AS n_points, sum(labeled::INT)::BIGINT AS n_labeled, bool_or(labeled) AS is_labeled FROM points GROUP BY unit)"""
COSTS = """costs AS (SELECT units.*, CASE WHEN NOT is_labeled AND region IN (SELECT region FROM units WHERE is_labeled) THEN 10.0::DOUBLE ELSE 15.0::DOUBLE END AS cost FROM units)"""


def unit_cost(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("unit"), (1 + F.col("c_custkey") % 20).cast("double").alias("cost"))


UNIT_COST = "unit_cost AS (SELECT c_custkey::VARCHAR AS unit, (1 + c_custkey % 20)::DOUBLE AS cost FROM customer)"


def geo(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return table(spark, d, "customer").select(key.alias("id"), (50 * uniform("lon", key)).alias("lon"), (25 * uniform("lat", key)).alias("lat"), F.col("c_nationkey").alias("nation"))


GEO = f"geo AS (SELECT c_custkey::VARCHAR AS id, 50 * {uniform_sql('lon', 'c_custkey')} AS lon, 25 * {uniform_sql('lat', 'c_custkey')} AS lat, c_nationkey AS nation FROM customer)"


def polygons(spark: SparkSession, d: str, without: int | None = None) -> DataFrame:
    """Nations as rectangles of 10 x 5 degrees on a sheet of 5 x 5; one may be left out."""
    n = table(spark, d, "nation")
    n = n.filter(F.col("n_nationkey") != without) if without is not None else n
    x, y = (F.col("n_nationkey") % 5) * 10.0, F.floor(F.col("n_nationkey") / 5) * 5.0
    ring = F.array(*[F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y")) for dx, dy in ((0, 0), (10, 0), (10, 5), (0, 5), (0, 0))])
    return n.select(F.col("n_nationkey").alias("polygon"), F.array(ring).alias("rings"))


POLYGONS = "polygons AS (SELECT n_nationkey AS polygon, (n_nationkey % 5) * 10.0::DOUBLE AS x, (n_nationkey // 5) * 5.0::DOUBLE AS y FROM nation)"


def places(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    return table(spark, d, "supplier").select((50 * uniform("lon", key)).alias("lon"), (25 * uniform("lat", key)).alias("lat"), F.col("s_acctbal").cast("double").alias("population"))


PLACES = f"places AS (SELECT 50 * {uniform_sql('lon', 's_suppkey')} AS lon, 25 * {uniform_sql('lat', 's_suppkey')} AS lat, s_acctbal::DOUBLE AS population FROM supplier)"


def axes(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Equal steps of 1.25 in longitude over 5..45, growing steps in latitude over 2..22."""
    lon = spark.range(33).select((F.col("id") + 1).cast("int").alias("idx"), (5 + F.col("id") * 1.25).alias("coord"))
    lat = spark.range(21).select((F.col("id") + 1).cast("int").alias("idx"), (2 + F.col("id") * 0.5 + F.col("id") * F.col("id") * 0.025).alias("coord"))
    return lon, lat


AXES = """lon_axis AS (SELECT (i + 1)::INT AS idx, 5 + i * 1.25::DOUBLE AS coord FROM range(33) t(i)),
lat_axis AS (SELECT (i + 1)::INT AS idx, 2 + i * 0.5::DOUBLE + i * i * 0.025::DOUBLE AS coord FROM range(21) t(i))"""


def ridge_rows(spark: SparkSession, d: str) -> DataFrame:
    """Line items with whole-number features and a linear outcome with hashed noise."""
    key = F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", F.floor(F.col("l_extendedprice").cast("double")), "l_linenumber")
    q, dis, tax = F.col("l_quantity").cast("double"), F.round(F.col("l_discount").cast("double") * 100), F.round(F.col("l_tax").cast("double") * 100)
    y = F.floor(3 * q - 2 * dis + 5 * tax + 40 * uniform("noise", key))
    return table(spark, d, "lineitem").select(key.alias("id"), F.col("l_returnflag").alias("run_id"), (F.col("l_orderkey") % 5).cast("int").alias("fold"), F.array(q, dis, tax).alias("x"), y.cast("double").alias("y"))


RIDGE = f"""ridge AS (SELECT concat_ws('|', l_orderkey, l_partkey, l_suppkey, floor(l_extendedprice::DOUBLE)::BIGINT, l_linenumber) AS id, l_returnflag AS run_id, (l_orderkey % 5)::INT AS fold,
  l_quantity::DOUBLE AS q, round(l_discount::DOUBLE * 100) AS dis, round(l_tax::DOUBLE * 100) AS tax FROM lineitem),
ridge_y AS (SELECT *, floor(3 * q - 2 * dis + 5 * tax + 40 * {uniform_sql('noise', 'id')}) AS y FROM ridge)"""


def labels_long(spark: SparkSession, d: str) -> DataFrame:
    """Part prices under three label names with every kind of missing value."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").cast("double").alias("v"))
    v = F.when(F.col("k") % 11 == 0, F.lit(None).cast("double")).when(F.col("k") % 13 == 0, float("nan")).when(F.col("k") % 17 == 0, float("inf")).when(F.col("k") % 19 == 0, -999.0).otherwise(F.col("v"))
    return p.select(F.col("k").cast("string").alias("id"), v.alias("value"), F.explode(F.array(*[F.lit(x) for x in ("housing", "elevation", "population")])).alias("label"))


LABELS = """labels AS (SELECT p_partkey AS k, p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 'nan'::DOUBLE WHEN p_partkey % 17 = 0 THEN 'inf'::DOUBLE
  WHEN p_partkey % 19 = 0 THEN -999.0::DOUBLE ELSE p_retailprice::DOUBLE END AS value FROM part),
clean AS (SELECT * FROM labels WHERE value IS NOT NULL AND NOT isnan(value) AND abs(value) < 'inf'::DOUBLE AND value <> -999)"""


def run_logs(spark: SparkSession, d: str) -> DataFrame:
    """One log a user and event type of the events: seeds are users modulo 10, budgets modulo 3."""
    e = table(spark, d, "events")
    own = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value"))).cast("double").alias("v"))
    seed, budget, v = F.col("user_id") % 10, (F.col("user_id") % 3 + 1) * 100, F.col("v") % 1000
    path = F.format_string("/out/u%d/TOGO_PH_H2O/ridge/cluster/multi_%d_size_seed_%d/uniform/%s/budget_%d/seed_%d/stdout.log", "user_id", F.col("user_id") % 2 * 50 + 50, seed, "event_type", budget, seed)
    text = F.format_string("Initial R² score: %.2f\nInitial MSE: %.1f\nSelected %d new samples\nUpdated R² score: %.2f\nUpdated MSE: %.1f\n", F.floor(v / 20) / 100, v + 100, F.col("n"), F.floor(v / 10) / 100, v)
    return own.select(path.alias("path"), text.alias("text"), "user_id", "event_type", "n", v.alias("v"), seed.alias("seed"), budget.alias("budget"))


LOGS = """log AS (SELECT user_id, event_type, count(*) AS n, (sum(floor(value)) % 1000)::DOUBLE AS v, user_id % 10 AS seed, (user_id % 3 + 1) * 100 AS budget,
  'multi_' || (user_id % 2 * 50 + 50) || '_size' AS init_set FROM events GROUP BY ALL)"""


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as 8 x 8 tiles with whole-number truth and prediction and a land-cover class."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("tile_id"), F.posexplode("embedding").alias("k", "v"))
    truth, noise = F.floor(F.col("v").cast("double") * 1000), F.col("k") * 7 % 5
    codes = F.array(*[F.lit(int(c)) for c in CODES.split(",")])
    at = F.when(F.col("tile_id") == "3", 17).otherwise(F.pmod(truth, F.lit(18))).cast("int")
    return e.select("tile_id", F.floor(F.col("k") / 8).cast("int").alias("row"), (F.col("k") % 8).cast("int").alias("col"), truth.cast("double").alias("truth"), (truth + noise).cast("double").alias("pred"), F.get(codes, at).alias("class"))


PIXELS = f"""px AS (SELECT vec_id::VARCHAR AS tile_id, unnest(range(len(embedding))) AS k, unnest(embedding) AS v FROM embeddings),
pixels AS (SELECT tile_id, k // 8 AS row, k % 8 AS col, floor(v::DOUBLE * 1000) AS truth, floor(v::DOUBLE * 1000) + k * 7 % 5 AS pred,
  [{CODES}][(CASE WHEN tile_id = '3' THEN 17 ELSE ((floor(v::DOUBLE * 1000)::BIGINT % 18) + 18) % 18 END) + 1] AS class FROM px)"""


def features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("x"), F.col("label").cast("string").alias("unit"))
