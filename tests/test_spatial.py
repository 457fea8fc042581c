"""Spatial joins against brute force, on bent polygons of very different sizes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplewright.functions import geo
from samplewright.operators import spatial

RINGS = "array<array<struct<x:double,y:double>>>"


def shapes():
    """U- and L-shapes, a thin far-reaching hook, one with a hole, and one that spans most of the sheet."""
    u = [(0, 0), (6, 0), (6, 4), (5, 4), (5, 1), (1, 1), (1, 4), (0, 4), (0, 0)]
    hook = [(0, 0), (30, 0), (30, 20), (29.9, 20), (29.9, 0.1), (0, 0.1), (0, 0)]
    square = [(0, 0), (3, 0), (3, 3), (0, 3), (0, 0)]
    hole = [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    small = [(0, 0), (0.02, 0), (0.02, 0.03), (0, 0)]
    at = lambda ring, x, y: [(a + x, b + y) for a, b in ring]
    return {1: [at(u, 2, 2)], 2: [at(hook, 5, 30)], 3: [at(square, 20, 10), at(hole, 20, 10)], 4: [at(small, 12.3, 20.1)], 5: [at(u, 3, 3)], 6: [at(hook, -150, -70)]}


def edges(rings):
    return [(*a, *b) for ring in rings for a, b in zip(ring, ring[1:], strict=False)]


def holds(rings, x, y):
    odd = False
    for ax, ay, bx, by in edges(rings):
        if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return False
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def by_sphere_of_curvature(lat1, lon1, lat2, lon2):
    """Metres of a short line on the WGS84 ellipsoid, by its radii of curvature at the middle: another formula than the library's."""
    a, e2 = 6378137.0, 1 / 298.257223563 * (2 - 1 / 298.257223563)
    p = math.radians((lat1 + lat2) / 2)
    w = 1 - e2 * math.sin(p) ** 2
    north, east = a * (1 - e2) / w**1.5, a / math.sqrt(w)
    return math.hypot(math.radians(lat2 - lat1) * north, math.radians((lon2 - lon1 + 180) % 360 - 180) * east * math.cos(p))


def near(rings, x, y, n=4000):
    """(place in the plane of degrees, least of the greater of both differences in degrees) to a polygon, by walking its edges."""
    if holds(rings, x, y):
        return (x, y), 0.0
    best, box = (math.inf, None), math.inf
    for turn in (-360, 0, 360):
        for ax, ay, bx, by in edges(rings):
            ax, bx = ax + turn, bx + turn
            dx, dy = bx - ax, by - ay
            t = min(1.0, max(0.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
            best = min(best, (math.hypot(ax + t * dx - x, ay + t * dy - y), (ax + t * dx, ay + t * dy)))
            s = np.linspace(0, 1, n)
            box = min(box, np.maximum(abs(ax + s * dx - x), abs(ay + s * dy - y)).min())
    return best[1], box


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(6)
    spots = [(float(x), float(y)) for x, y in zip(rng.uniform(-5, 45, 250), rng.uniform(-5, 60, 250), strict=True)]
    spots += [(2.0, 3.0), (21.5, 11.5), (4.5, 4.5), (12.31, 20.105), (-170.0, 10.0), (179.0, 85.0), (34.0, 40.0)]
    points = spark.createDataFrame([(str(i), *p) for i, p in enumerate(spots)], "id string, lon double, lat double")
    polygons = spark.createDataFrame([(k, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in v]) for k, v in shapes().items()], f"polygon int, rings {RINGS}")
    return spots, points, polygons


def test_points_within_bent_polygons(tables):
    spots, points, polygons = tables
    got = {int(r["id"]): r["polygon"] for r in spatial.points_within_polygons(points, polygons).collect()}
    assert got == {i: min((k for k, r in shapes().items() if holds(r, *p)), default=None) for i, p in enumerate(spots)}
    assert len(set(got.values())) >= 4


def test_a_crowded_cell_is_divided(spark, monkeypatch):
    """90 % of the points in one cell, half of these at one spot: the same result, and no key with more than a share of them."""
    rng = np.random.default_rng(2)
    spots = [(float(x), float(y)) for x, y in zip(rng.uniform(2, 3, 1000), rng.uniform(3, 4, 1000), strict=True)] + [(2.5, 3.5)] * 800
    spots += [(float(x), float(y)) for x, y in zip(rng.uniform(-5, 45, 200), rng.uniform(-5, 60, 200), strict=True)]
    # crowded cells wholly inside, cut by an edge, in a hole and outside
    own = dict(shapes()) | {7: [[(1.0, 2.0), (4.0, 2.0), (4.0, 5.0), (1.0, 5.0), (1.0, 2.0)]], 8: [[(2.0, 3.0), (2.9, 3.2), (2.1, 3.9), (2.0, 3.0)]], 9: [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0), (0.0, 0.0)], [(2.2, 3.2), (2.8, 3.2), (2.8, 3.8), (2.2, 3.8), (2.2, 3.2)]]}
    points = spark.createDataFrame([(str(i), *p) for i, p in enumerate(spots)], "id string, lon double, lat double")
    polygons = spark.createDataFrame([(-k, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in v]) for k, v in own.items()], f"polygon int, rings {RINGS}")
    want = {i: min((-k for k, r in own.items() if holds(r, *p)), default=None) for i, p in enumerate(spots)}
    assert len(set(want.values())) >= 4
    for most in (20_000, 50):
        monkeypatch.setattr(spatial, "CELL_POINTS", most)
        assert {int(r["id"]): r["polygon"] for r in spatial.points_within_polygons(points, polygons).collect()} == want
    boxed = polygons.select("polygon", "rings", geo.bbox(F.col("rings")).alias("b"))
    celled = spatial.in_cells(boxed, [F.col("b")[c] for c in ("x0", "y0", "x1", "y1")], 1.0)
    levels = [r["level"] for r in celled.select("level").distinct().collect()]
    keyed, met = spatial.divided(points, celled, 1.0, levels)
    assert max(r["count"] for r in keyed.groupBy(*spatial.KEYS).count().collect()) < 0.06 * len(spots)
    assert met.count() < celled.count() * 64 * 32 / 10


def check_nearest(spots, own, got):
    for i, p in enumerate(spots):
        every = {k: near(r, *p) for k, r in own.items()}
        if any(abs(b - 0.5) < 1e-2 for _, b in every.values()):
            continue  # the walk is too coarse to tell
        metres = {k: float(geo.ellipsoidal_metres(*(np.array([v]) for v in (p[1], p[0], q[1], q[0])))[0]) for k, (q, _) in every.items()}
        close = {k: metres[k] for k, (_, b) in every.items() if b <= 0.5} or metres
        assert got[i][0] == min(close, key=lambda k: (round(close[k], 6), k)) and got[i][1] == pytest.approx(close[got[i][0]], abs=1e-3)


def test_nearest_of_bent_polygons(tables):
    spots, points, polygons = tables
    got = {int(r["id"]): (r["polygon"], r["metres"]) for r in spatial.nearest_polygon(points, polygons).collect()}
    assert len(got) == len(spots)
    check_nearest(spots, shapes(), got)


@pytest.mark.parametrize("lat", [0.0, 45.0, 70.0])
def test_nearest_at_latitudes_and_over_the_date_line(spark, lat):
    u = shapes()[1][0]
    at = lambda x, y, k=0.2: [[((a - 2) * k + x, (b - 2) * k + y) for a, b in u]]
    own = {1: at(178.6, lat), 2: at(-179.6, lat + 0.7), 3: at(170.0, lat - 1.5), 4: at(0.0, lat), 5: at(1.7, lat + 0.2)}
    rng = np.random.default_rng(int(lat))
    spots = [(float((x + 180) % 360 - 180), float(y)) for x, y in zip(rng.uniform(177, 183, 60), rng.uniform(lat - 3, lat + 3, 60), strict=True)]
    spots += [(float(x), float(y)) for x, y in zip(rng.uniform(-1, 3, 40), rng.uniform(lat - 1, lat + 2, 40), strict=True)]
    points = spark.createDataFrame([(str(i), *p) for i, p in enumerate(spots)], "id string, lon double, lat double")
    polygons = spark.createDataFrame([(k, [[{"x": x, "y": y} for x, y in ring] for ring in v]) for k, v in own.items()], f"polygon int, rings {RINGS}")
    got = {int(r["id"]): (r["polygon"], r["metres"]) for r in spatial.nearest_polygon(points, polygons).collect()}
    check_nearest(spots, own, got)
    assert any(got[i][0] == 2 and p[0] > 0 for i, p in enumerate(spots))


def test_ellipsoidal_distances():
    m = lambda *v: float(geo.ellipsoidal_metres(*(np.array([x]) for x in v))[0])
    assert m(0.0, 0.0, 0.0, 90.0) == pytest.approx(math.pi / 2 * 6378137.0, abs=1e-3)  # a quarter of the equator
    assert m(0.0, 5.0, 90.0, 5.0) == pytest.approx(10_001_965.729, abs=1e-2)  # a quarter of a meridian
    rng = np.random.default_rng(1)
    for lat, lon, d, e in zip(rng.uniform(-80, 80, 200), rng.uniform(-180, 180, 200), rng.uniform(-0.05, 0.05, 200), rng.uniform(-0.05, 0.05, 200), strict=True):
        assert m(lat, lon, lat + d, lon + e) == pytest.approx(by_sphere_of_curvature(lat, lon, lat + d, lon + e), rel=2e-6, abs=1e-3)
    assert m(3.0, 4.0, 3.0, 4.0) == 0 and m(0.0, 0.0, 0.3, 179.9) == pytest.approx(2.0e7, rel=0.01)


def brute_axis(v, coord):
    half = (max(coord) - min(coord)) / (len(coord) - 1) / 2 if len(coord) > 1 else 0.0
    if v is None or v != v or v < min(coord) - half or v > max(coord) + half:
        return None
    return min(range(len(coord)), key=lambda k: (round(abs(coord[k] - v), 12), coord[k])) + 1


@pytest.mark.parametrize("ranges", [False, True])
def test_nearest_grid_index_equals_brute_force(spark, monkeypatch, ranges):
    if ranges:
        monkeypatch.setattr(spatial, "AXIS_ROWS", 3)
        monkeypatch.setattr(spatial, "BUCKET_ROWS", 40)
    rng = np.random.default_rng(5)
    lons, lats = np.round(np.cumsum(rng.uniform(0.1, 4, 30)), 3).tolist(), np.arange(10, 20, 0.25).tolist()[::-1]
    spots = [(float(x), float(y)) for x, y in zip(rng.uniform(-3, max(lons) + 3, 150), rng.uniform(9, 21, 150), strict=True)]
    spots += [(lons[3], 12.125)] * 100 + [(lons[0], 9.9), (lons[-1], 25.0), (None, 12.0), (float("nan"), 12.0), ((lons[4] + lons[5]) / 2, 10.0)]
    points = spark.createDataFrame([(str(i), *p, [1, 2]) for i, p in enumerate(spots)], "id string, lon double, lat double, other array<int>")
    axes = [spark.createDataFrame([(k + 1, c) for k, c in enumerate(a)], "idx int, coord double") for a in (lons, lats)]
    df = spatial.nearest_grid_index(points, *axes)
    got = {int(r["id"]): (r["i"], r["j"]) for r in df.collect()}
    assert got == {i: (brute_axis(x, lons), brute_axis(y, lats)) for i, (x, y) in enumerate(spots)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange" in plan) == ranges and set(df.columns) == {"id", "lon", "lat", "other", "i", "j"}
    assert spatial.nearest_grid_index(points.limit(0), *axes).count() == 0


def test_spatial_joins_have_an_equal_key(spark, tables):
    _, points, polygons = tables
    for df in (spatial.points_within_polygons(points, polygons), spatial.nearest_polygon(points, polygons), spatial.land_filter(points, polygons)):
        plan = df._jdf.queryExecution().toString()
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_no_polygons_and_no_points(tables):
    _, points, polygons = tables
    assert spatial.nearest_polygon(points.limit(0), polygons).count() == 0
    assert spatial.nearest_polygon(points, polygons.limit(0)).count() == 0
    assert spatial.points_within_polygons(points, polygons.limit(0)).filter("polygon is null").count() == points.count()
