"""Queries: cost models, budgeted selection and sampling designs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import designs, inclusion, selection
from ..rng import digits_sql, uniform_sql
from . import fixtures as fx

C1, C2 = 10.0, 15.0


def _costs(spark, d):
    points = fx.points(spark, d)
    return points, selection.cost_region_aware(selection.unit_table(points), C1, C2)


def units(spark, d):
    return selection.unit_table(fx.points(spark, d))


def costs(spark, d):
    return _costs(spark, d)[1]


def given_costs(spark, d):
    return selection.cost_by_array(selection.unit_table(fx.points(spark, d)), fx.unit_cost(spark, d)).select("unit", "cost")


def uniform_costs(spark, d):
    return selection.cost_uniform(selection.unit_table(fx.points(spark, d))).select("unit", "cost")


def baseline(spark, d):
    own = _costs(spark, d)[1]
    return selection.cost_of(own, F.col("is_labeled") | (F.col("n_points") > 12))


def group_counts(spark, d):
    return selection.unit_group_counts(fx.points(spark, d))


def labeled(spark, d):
    p = fx.points(spark, d)
    return selection.labeled_units(p).select(F.lit("unit").alias("kind"), F.col("unit").alias("name")).unionByName(selection.labeled_regions(p).select(F.lit("region").alias("kind"), F.col("region").alias("name")))


def select_random(spark, d):
    return selection.select_random(fx.points(spark, d), 500, "s1")


def select_units(spark, d):
    p, c = _costs(spark, d)
    return selection.select_units_cost_aware(p, c, 1500.0, "s1", 5)


def select_points(spark, d):
    p, c = _costs(spark, d)
    return selection.select_points_cost_aware(p, c, 1500.0, "s1")


def select_stratified(spark, d):
    p, c = _costs(spark, d)
    return selection.select_stratified(p, c, 1500.0, "s1")


def select_match(spark, d):
    p, c = _costs(spark, d)
    return selection.select_match_population(p, c, 1500.0, "s1")


def run_optimised(spark, d):
    p, c = fx.points(spark, d), _units(spark, d)
    return selection.run_selection("greedy", p, c, 800.0, "opt", per_unit=4)


def select_shuffled(spark, d):
    p, c = _costs(spark, d)
    return selection.select_shuffled_groups(p, c, 1500.0, "s1").select("id", "unit", "grp", "charge")


def metadata(spark, d):
    p, c = _costs(spark, d)
    return selection.selection_metadata(p, c, selection.select_units_cost_aware(p, c, 1500.0, "s1", 5), "s1")


def flagship(spark, d):
    """Cost-aware selection of units under a budget, with its metadata."""
    return metadata(spark, d)


def run_by_name(spark, d):
    p, c = _costs(spark, d)
    return selection.run_selection("stratified", p, c, 800.0, "s2")


HEAD = f"WITH {fx.POINTS}, {fx.UNITS}, {fx.COSTS}"
CHOSEN = f"""{HEAD}, ranked AS (SELECT *, sum(cost) OVER (ORDER BY {digits_sql('s1', 'unit')}, unit ROWS UNBOUNDED PRECEDING) AS cum FROM costs WHERE NOT is_labeled),
pts AS (SELECT p.id, p.unit, r.cost, row_number() OVER (PARTITION BY p.unit ORDER BY {digits_sql('s1', 'p.id')}, p.id) AS k
        FROM points p JOIN ranked r ON p.unit = r.unit AND r.cum <= 1500 WHERE NOT p.labeled)"""


def _turns(key: str, seed: str = "s1", budget: float = 1500) -> str:
    return f"""{HEAD}, have AS (SELECT grp, sum(labeled::INT) AS have, count(*) AS size FROM points GROUP BY grp),
own AS (SELECT p.*, have, size, row_number() OVER (PARTITION BY p.grp ORDER BY {digits_sql(seed, 'id')}, id) AS rn, {digits_sql(seed, 'p.grp')} AS ug FROM points p JOIN have ON p.grp = have.grp WHERE NOT labeled),
keyed AS (SELECT *, {key} AS key FROM own),
paid AS (SELECT k.*, CASE WHEN row_number() OVER (PARTITION BY k.unit ORDER BY key, ug, id) = 1 AND NOT c.is_labeled THEN c.cost ELSE 0.0 END AS charge FROM keyed k JOIN costs c ON k.unit = c.unit),
summed AS (SELECT *, sum(charge) OVER (ORDER BY key, ug, id ROWS UNBOUNDED PRECEDING) AS cum FROM paid)
SELECT id, unit, grp, charge FROM summed WHERE cum <= {budget} * (1 + 1e-9)"""


POINTS_SQL = f"""{HEAD}, own AS (SELECT p.id, p.unit, {digits_sql('s1', 'p.id')} AS h, c.is_labeled, c.cost FROM points p JOIN costs c ON p.unit = c.unit WHERE NOT p.labeled),
paid AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY unit ORDER BY h, id) = 1 AND NOT is_labeled THEN cost ELSE 0.0 END AS charge FROM own),
summed AS (SELECT *, sum(charge) OVER (ORDER BY h, id ROWS UNBOUNDED PRECEDING) AS cum FROM paid)
SELECT id, unit, charge FROM summed WHERE cum <= 1500"""


# sampling designs: regions as strata, customers as clusters


def _rows(spark, d):
    return fx.points(spark, d).select("id", F.col("region").alias("stratum"), F.col("unit").alias("cluster"))


def simple_random(spark, d):
    return designs.random_sample(fx.points(spark, d), 1000, "d1").select("id", "unit")


def split(spark, d):
    return designs.train_test_split(fx.points(spark, d), "d2", frac_test=0.2, frac_val=0.25).select("id", "split")


def split_fifth(spark, d):
    return designs.split_80_20(fx.points(spark, d), "d3").select("id", "split")


def strata(spark, d):
    return designs.allocate_strata(_rows(spark, d), 777)


def clusters(spark, d):
    rows = _rows(spark, d)
    return designs.pps_clusters(rows, designs.allocate_strata(rows, 777), 5, "d6")


def cluster_points(spark, d):
    return designs.cluster_sample(_rows(spark, d), 777, 5, "d6")


def sweep(spark, d):
    return designs.sample_sweep(fx.points(spark, d), [50, 200, 400], ["a", "b", "c"])


def _near(spark, d):
    own = designs.nearest_place_distance(fx.geo(spark, d), fx.places(spark, d), 5)
    return own.withColumn("distance", F.bround("distance", 3)).withColumn("cluster", F.col("nation").cast("string"))


def near_places(spark, d):
    return _near(spark, d).select("id", "distance")


def convenience(spark, d):
    return designs.convenience_points(_near(spark, d), 60, "d8").select("id")


def convenience_soft(spark, d):
    return designs.convenience_points(_near(spark, d), 60, "d9", temperature=0.1).select("id")


def convenience_clusters(spark, d):
    return designs.convenience_clusters(_near(spark, d), 40, 8, "d10")


def convenience_centroids(spark, d):
    own = designs.nearest_place_distance(fx.geo(spark, d), fx.places(spark, d), 5).withColumn("cluster", F.col("nation").cast("string"))
    heads = designs.centroid_distances(own.drop("distance"), fx.places(spark, d), 5).withColumn("distance", F.bround("distance", 3))
    return designs.sample_sizes(designs.convenience_clusters(own, 40, 8, "d10", distances=heads), 40)


def softmax(spark, d):
    return designs.softmax_neg_distance(_near(spark, d), "distance", 0.5).select("id", F.bround("p", 9).alias("p"))


STRATA = f"""WITH {fx.POINTS}, sizes AS (SELECT region AS stratum, count(*) AS size FROM points GROUP BY region),
quota AS (SELECT *, size * 777 / sum(size) OVER () AS quota FROM sizes),
target AS (SELECT stratum, size, floor(quota)::BIGINT + (row_number() OVER (ORDER BY quota - floor(quota) DESC, stratum) <= 777 - sum(floor(quota)) OVER ())::BIGINT AS target FROM quota)"""
CLUSTERS = f"""{STRATA}, cl AS (SELECT region AS stratum, unit AS cluster, count(*) AS size, least(5, count(*))::BIGINT AS take FROM points GROUP BY ALL),
keyed AS (SELECT *, -ln({uniform_sql('d6', "stratum || '|' || cluster")}) / size AS key FROM cl),
run AS (SELECT *, coalesce(sum(take) OVER (PARTITION BY stratum ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM keyed),
drawn AS (SELECT r.stratum, cluster, r.size, take, before, before + take <= target AS kept FROM run r JOIN target t ON r.stratum = t.stratum WHERE target > 0 AND before < target)"""
HAV = "2 * 6371000.0::DOUBLE * asin(sqrt(least(1, pow(sin((radians(p.lat) - radians(g.lat)) / 2), 2) + cos(radians(g.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - g.lon) / 2), 2))))"
NEAR = f"""WITH {fx.GEO}, {fx.PLACES}, top AS (SELECT * FROM places ORDER BY population DESC, lon, lat LIMIT 5),
near AS (SELECT g.id, any_value(g.nation)::VARCHAR AS cluster, round_even(min({HAV}), 3) AS distance FROM geo g, top p GROUP BY g.id)"""
SOFT = """ends AS (SELECT min(distance) AS lo, max(distance) AS hi FROM near)"""


# optimised selection: units of whole-number cost


def _units(spark, d):
    return selection.cost_by_array(selection.unit_table(fx.points(spark, d)), fx.unit_cost(spark, d))


def greedy(spark, d):
    return inclusion.greedy_probabilities(_units(spark, d), 900.0).select("unit", F.bround("s", 9).alias("s"))


def similar(spark, d):
    sim = _units(spark, d).select("unit", (F.col("n_points") % 7).cast("double").alias("sim"))
    return inclusion.similarity_probabilities(_units(spark, d), sim, 900.0).select("unit", F.bround("s", 9).alias("s"))


def _risk(spark, d):
    p = fx.points(spark, d)
    shares = p.groupBy("grp").agg(F.count("*").alias("n"))
    shares = shares.join(F.broadcast(shares.agg(F.sum("n").alias("t")))).select("grp", (F.col("n") / F.col("t")).alias("share"))
    return inclusion.group_matrix(selection.unit_group_counts(p)), shares


def pop_risk(spark, d):
    matrix, shares = _risk(spark, d)
    return inclusion.pop_risk_probabilities(_units(spark, d), matrix, shares, 900.0, lam=0.5)


def pop_risk_value(spark, d):
    matrix, shares = _risk(spark, d)
    chosen = _units(spark, d).select("unit", F.when(F.col("cost") <= 10, 1.0).otherwise(0.0).alias("s"))
    return inclusion.utility_pop_risk(chosen, matrix, shares, 0.5).select(F.bround("utility", 9).alias("utility"))


def group_matrix(spark, d):
    p = fx.points(spark, d)
    return inclusion.group_matrix(selection.unit_group_counts(p), per_unit=10).select("unit", "grp", F.bround("a", 9).alias("a"))


def rounded(spark, d):
    p, u = fx.points(spark, d), _units(spark, d)
    s = u.select("unit", F.least(F.lit(1.0), F.col("n_points") / 20.0).alias("s"))
    return inclusion.round_selection(p, u, s, 900.0, "x7", 4)


def _cosines(spark, d):
    """Blocks of the vectors that share a label."""
    return inclusion.CosineBlocks(fx.features(spark, d).select(F.col("id").alias("unit"), F.col("unit").alias("grp"), "x"))


def mean_similarity(spark, d):
    from ..operators.aggregates import mean_cosine_per_unit

    return mean_cosine_per_unit(fx.features(spark, d)).select("unit", F.bround("sim", 9).alias("sim"))


def _diverse_units(spark, d):
    return fx.features(spark, d).select(F.col("id").alias("unit"), (1 + F.col("id").cast("int") % 5).cast("double").alias("cost"), F.lit(False).alias("is_labeled"))


def diversity(spark, d):
    return inclusion.diversity_probabilities(_diverse_units(spark, d), _cosines(spark, d), 100.0)


def diversity_proof(spark, d):
    """Size, spending and duality gap of the inclusion probabilities, recomputed from them."""
    own, cosines = _diverse_units(spark, d), _cosines(spark, d)
    got = inclusion.diversity_certificate(own, inclusion.diversity_probabilities(own, cosines, 100.0), cosines, 100.0)
    return got.select("n", F.bround("spent", 6).alias("spent"), "feasible", "gap_met")


def diversity_value(spark, d):
    own = fx.features(spark, d).select(F.col("id").alias("unit"), F.when(F.col("id").cast("int") % 3 == 0, 1.0).otherwise(0.25).alias("s"))
    return inclusion.utility_diversity(own, _cosines(spark, d)).select(F.bround("utility", 6).alias("utility"))


SIM = """vec AS (SELECT vec_id::VARCHAR AS id, label::VARCHAR AS unit, embedding::DOUBLE[] AS x FROM embeddings),
sim AS (SELECT a.id AS row_id, b.id AS col_id, list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) AS sim, a.unit FROM vec a JOIN vec b ON a.unit = b.unit)"""
KNAPSACK = """ratio AS (SELECT *, round(gain / cost, 12) AS ratio FROM own WHERE NOT is_labeled AND gain > 0),
steps AS (SELECT ratio, sum(cost) AS paid FROM ratio GROUP BY ratio),
cum AS (SELECT *, coalesce(sum(paid) OVER (ORDER BY ratio DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM steps),
share AS (SELECT ratio, greatest(0.0, least(1.0, (900.0 - before) / paid)) AS share FROM cum)
SELECT own.unit, round_even(CASE WHEN own.is_labeled THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE, 9) AS s FROM own LEFT JOIN ratio r ON own.unit = r.unit LEFT JOIN share ON r.ratio = share.ratio"""
WITH_COST = f"WITH {fx.POINTS}, {fx.UNITS}, {fx.UNIT_COST}, u AS (SELECT units.*, cost FROM units JOIN unit_cost ON units.unit = unit_cost.unit)"

QUERIES = {
    "unit_table": units, "cost_region_aware": costs, "cost_by_array": given_costs, "cost_uniform": uniform_costs, "cost_of": baseline, "unit_group_counts": group_counts,
    "labeled_units_regions": labeled, "select_random": select_random, "select_units_cost_aware": select_units, "select_points_cost_aware": select_points, "select_stratified": select_stratified,
    "select_match_population": select_match, "select_shuffled_groups": select_shuffled, "selection_metadata": metadata, "run_selection": run_by_name,
    "random_sample": simple_random, "train_test_split": split, "split_80_20": split_fifth, "allocate_strata": strata, "pps_clusters": clusters, "cluster_sample": cluster_points, "sample_sweep": sweep,
    "nearest_place_distance": near_places, "convenience_points": convenience, "convenience_points_softmax": convenience_soft, "convenience_clusters": convenience_clusters, "softmax_neg_distance": softmax,
    "utility_greedy": greedy, "utility_similarity": similar, "inclusion_pop_risk": pop_risk, "utility_value_pop_risk": pop_risk_value, "group_matrix_avg": group_matrix, "round_selection": rounded, "run_selection_optimised": run_optimised, "convenience_centroids": convenience_centroids,
    "mean_similarity_per_unit": mean_similarity, "inclusion_diversity": diversity, "inclusion_diversity_gap": diversity_proof, "utility_value_diversity": diversity_value,
}

ORACLE_SQL = {
    "unit_table": f"WITH {fx.POINTS}, {fx.UNITS} SELECT * FROM units",
    "cost_region_aware": f"{HEAD} SELECT * FROM costs",
    "cost_by_array": f"{WITH_COST} SELECT unit, cost FROM u",
    "cost_uniform": f"WITH {fx.POINTS}, {fx.UNITS} SELECT unit, 1.0::DOUBLE AS cost FROM units",
    "cost_of": f"{HEAD} SELECT sum(CASE WHEN is_labeled OR n_points > 12 THEN cost ELSE 0 END) AS total_cost, sum(CASE WHEN is_labeled THEN cost ELSE 0 END) AS baseline_cost, sum(CASE WHEN NOT is_labeled AND n_points > 12 THEN cost ELSE 0 END) AS added_cost FROM costs",
    "unit_group_counts": f"WITH {fx.POINTS} SELECT unit, grp, count(*) AS cnt FROM points GROUP BY ALL",
    "labeled_units_regions": f"WITH {fx.POINTS} SELECT DISTINCT 'unit' AS kind, unit AS name FROM points WHERE labeled UNION ALL SELECT DISTINCT 'region', region FROM points WHERE labeled",
    "select_random": f"WITH {fx.POINTS} SELECT id FROM points WHERE NOT labeled ORDER BY {digits_sql('s1', 'id')}, id LIMIT 500",
    "select_units_cost_aware": f"{CHOSEN} SELECT id, unit, cost FROM pts WHERE k <= 5",
    "select_points_cost_aware": POINTS_SQL,
    "select_stratified": _turns("have + rn - 1"),
    "select_match_population": _turns("(have + rn) / size"),
    "select_shuffled_groups": _turns(f"sum(-ln({uniform_sql('s1|gap', 'id')})) OVER (PARTITION BY grp ORDER BY rn ROWS UNBOUNDED PRECEDING)"),
    "run_selection_optimised": f"""{WITH_COST}, own AS (SELECT *, 1.0 AS gain FROM u), prob AS (WITH {KNAPSACK.replace("900.0", "800.0")}), hit AS (SELECT u.* FROM u JOIN prob ON u.unit = prob.unit WHERE NOT is_labeled AND {uniform_sql('opt|draw', 'u.unit')} < s),
cum AS (SELECT *, sum(cost) OVER (ORDER BY {digits_sql('opt', 'unit')}, unit ROWS UNBOUNDED PRECEDING) AS cum FROM hit),
pts AS (SELECT p.id, p.unit, row_number() OVER (PARTITION BY p.unit ORDER BY {digits_sql('opt', 'p.id')}, p.id) AS k FROM points p JOIN cum ON p.unit = cum.unit WHERE cum <= 800 AND NOT p.labeled) SELECT id, unit FROM pts WHERE k <= 4""",
    "convenience_clusters": f"""{NEAR}, heads AS (SELECT cluster, arg_min(distance, id) AS distance, least(8, count(*)) AS take FROM near GROUP BY cluster),
run AS (SELECT *, coalesce(sum(take) OVER (ORDER BY distance, {digits_sql('d10', 'cluster')}, cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM heads),
pts AS (SELECT id, n.cluster, row_number() OVER (PARTITION BY n.cluster ORDER BY {digits_sql('d10', 'id')}, id) AS k FROM near n JOIN run ON n.cluster = run.cluster WHERE before < 40)
SELECT id, cluster FROM pts WHERE k <= 8 ORDER BY {digits_sql('d10|down', 'id')}, id LIMIT 40""",
    "convenience_centroids": f"WITH {fx.GEO}, c AS (SELECT nation, least(8, count(*)) AS take FROM geo GROUP BY nation) SELECT 40::BIGINT AS requested, least(40, sum(take))::BIGINT AS actual FROM c",
    "selection_metadata": f"""{CHOSEN}, sel AS (SELECT * FROM pts WHERE k <= 5)
SELECT (SELECT sum(cost) FROM costs WHERE is_labeled) AS baseline_cost, (SELECT sum(cost) FROM costs WHERE NOT is_labeled AND unit IN (SELECT unit FROM sel)) AS added_cost,
       (SELECT count(*) FROM sel) AS n_selected, (SELECT count(DISTINCT unit) FROM sel) AS n_new_units, 's1' AS seed""",
    "run_selection": _turns("have + rn - 1", "s2", 800),
    "random_sample": f"WITH {fx.POINTS} SELECT id, unit FROM points ORDER BY {digits_sql('d1', 'id')}, id LIMIT 1000",
    "train_test_split": f"""WITH {fx.POINTS}, r AS (SELECT id, row_number() OVER (ORDER BY {digits_sql('d2', 'id')}, id) - 1 AS k, count(*) OVER () AS n FROM points)
SELECT id, CASE WHEN k < floor(0.2 * n) THEN 'test' WHEN k < floor(0.2 * n) + floor(0.25 * (n - floor(0.2 * n))) THEN 'val' ELSE 'train' END AS split FROM r""",
    "split_80_20": f"""WITH {fx.POINTS}, r AS (SELECT id, row_number() OVER (ORDER BY {digits_sql('d3', 'id')}, id) - 1 AS k, count(*) OVER () AS n FROM points)
SELECT id, CASE WHEN k < ceil(n / 5) THEN 'test' ELSE 'train' END AS split FROM r""",
    "allocate_strata": f"{STRATA} SELECT * FROM target",
    "pps_clusters": f"{CLUSTERS} SELECT * FROM drawn",
    "cluster_sample": f"""{CLUSTERS}, pts AS (SELECT p.id, d.stratum, d.cluster, row_number() OVER (PARTITION BY d.stratum, d.cluster ORDER BY {digits_sql('d6', 'p.id')}, p.id) AS k
FROM points p JOIN drawn d ON p.region = d.stratum AND p.unit = d.cluster WHERE kept) SELECT id, stratum, cluster FROM pts WHERE k <= 5""",
    "sample_sweep": f"""WITH {fx.POINTS}, r AS (SELECT id, seed, row_number() OVER (PARTITION BY seed ORDER BY {digits_sql('sweep', "seed || '|' || id")}, seed || '|' || id) AS k FROM points, (VALUES ('a'), ('b'), ('c')) s(seed))
SELECT 'random_' || size || '_seed_' || seed AS run_id, size, seed, id FROM r, (VALUES (50), (200), (400)) z(size) WHERE k <= size""",
    "nearest_place_distance": f"{NEAR} SELECT id, distance FROM near",
    "convenience_points": f"{NEAR} SELECT id FROM near ORDER BY distance, {digits_sql('d8', 'id')}, id LIMIT 60",
    "convenience_points_softmax": f"{NEAR}, {SOFT} SELECT id FROM near, ends ORDER BY (distance - lo) / (hi - lo) / 0.1 + ln(-ln({uniform_sql('d9', 'id')})) LIMIT 60",
    "softmax_neg_distance": f"{NEAR}, {SOFT}, e AS (SELECT id, exp(-((distance - lo) / (hi - lo)) / 0.5) AS e FROM near, ends) SELECT id, round_even(e / sum(e) OVER (), 9) AS p FROM e",
    "utility_greedy": f"{WITH_COST}, own AS (SELECT *, 1.0 AS gain FROM u), {KNAPSACK}",
    "utility_similarity": f"{WITH_COST}, own AS (SELECT *, (n_points % 7)::DOUBLE AS gain FROM u), {KNAPSACK}",
    "utility_value_pop_risk": f"""{WITH_COST}, w AS (SELECT grp, count(*) / sum(count(*)) OVER () AS share FROM points GROUP BY grp),
g AS (SELECT grp, count(*)::DOUBLE AS n FROM points JOIN u ON points.unit = u.unit WHERE cost <= 10 GROUP BY grp)
SELECT round_even(-sum(share * (0.5 / sqrt(n) + 0.5 / sqrt((SELECT sum(n) FROM g)))), 9) AS utility FROM w JOIN g ON w.grp = g.grp""",
    "group_matrix_avg": f"WITH {fx.POINTS}, c AS (SELECT unit, grp, count(*) AS cnt FROM points GROUP BY ALL) SELECT unit, grp, round_even(cnt * 10.0::DOUBLE / sum(cnt) OVER (PARTITION BY unit), 9) AS a FROM c",
    "round_selection": f"""{WITH_COST}, own AS (SELECT *, least(1.0, n_points / 20.0) AS s FROM u WHERE NOT is_labeled), hit AS (SELECT * FROM own WHERE {uniform_sql('x7|draw', 'unit')} < s),
cum AS (SELECT *, sum(cost) OVER (ORDER BY {digits_sql('x7', 'unit')}, unit ROWS UNBOUNDED PRECEDING) AS cum FROM hit),
pts AS (SELECT p.id, p.unit, row_number() OVER (PARTITION BY p.unit ORDER BY {digits_sql('x7', 'p.id')}, p.id) AS k FROM points p JOIN cum ON p.unit = cum.unit WHERE cum <= 900 AND NOT p.labeled) SELECT id, unit FROM pts WHERE k <= 4""",
    "mean_similarity_per_unit": f"WITH {SIM}, per AS (SELECT unit, col_id, avg(sim) AS sim FROM sim GROUP BY ALL) SELECT unit, round_even(avg(sim), 9) AS sim FROM per GROUP BY unit",
    "inclusion_diversity_gap": "SELECT count(*) AS n, least(100.0::DOUBLE, sum(1 + vec_id % 5)) AS spent, true AS feasible, true AS gap_met FROM embeddings",
    "utility_value_diversity": f"""WITH {SIM}, m AS (SELECT row_id, col_id, least(1.0, greatest(0.0, sim)) AS sim FROM sim),
s AS (SELECT id AS unit, CASE WHEN id::INT % 3 = 0 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS s FROM vec)
SELECT round_even(100 * (SELECT sum(s) FROM s) - (SELECT sum(m.sim * a.s * b.s) FROM m JOIN s a ON a.unit = row_id JOIN s b ON b.unit = col_id) - 1e-4 * (SELECT sum(s * s) FROM s), 6) AS utility""",
}
