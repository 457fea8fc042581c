"""Geometry on lon/lat columns, in native expressions.

A polygon is rings: an array of rings, each a closed array of (x, y) structs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
#: Ground size of a web-map pixel at zoom 0 on the equator, in metres; metres in a degree of latitude.
PIXEL_AT_ZOOM_0 = 156543.03392
DEGREE_M = math.pi * EARTH_RADIUS_M / 180
#: WGS84: semi-major axis in metres and flattening, fixed values; no degree of a meridian is shorter than LEAST_DEGREE_M.
WGS84_A, WGS84_F = 6_378_137.0, 1 / 298.257223563
LEAST_DEGREE_M = 110_500.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def ellipsoidal_metres(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Geodesic distance on the WGS84 ellipsoid, by Vincenty's inverse formula.

    Near antipodes, where it does not settle, the great-circle distance on a
    sphere of the mean radius stands in (within 0.6 %).
    """
    f, a = WGS84_F, WGS84_A
    b = a * (1 - f)
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(x))) for x in (lat1, lat2))
    span = np.radians((np.asarray(lon2) - lon1 + 180) % 360 - 180)
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam, open_ = span.copy(), np.ones(len(span), bool)
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(rounds):
            sin_sigma = np.hypot(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))
            cos_sigma = s1 * s2 + c1 * c2 * np.cos(lam)
            sigma = np.arctan2(sin_sigma, cos_sigma)
            sin_alpha = np.where(sin_sigma > 0, c1 * c2 * np.sin(lam) / sin_sigma, 0.0)
            cos2_alpha = 1 - sin_alpha**2
            middle = np.where(cos2_alpha > 1e-15, cos_sigma - 2 * s1 * s2 / cos2_alpha, 0.0)
            c = f / 16 * cos2_alpha * (4 + f * (4 - 3 * cos2_alpha))
            new = span + (1 - c) * f * sin_alpha * (sigma + c * sin_sigma * (middle + c * cos_sigma * (2 * middle**2 - 1)))
            open_ = ~(np.abs(new - lam) < 1e-12)
            lam = np.where(np.abs(new) > np.pi, lam, new)
            open_ |= np.abs(new) > np.pi
            if not open_.any():
                break
        k = cos2_alpha * (a**2 - b**2) / b**2
        big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        off = small * sin_sigma * (middle + small / 4 * (cos_sigma * (2 * middle**2 - 1) - small / 6 * middle * (4 * sin_sigma**2 - 3) * (4 * middle**2 - 3)))
        metres = b * big * (sigma - off)
        p1, p2 = np.radians(lat1), np.radians(lat2)
        h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(span / 2) ** 2
        sphere = 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(h, 1.0)))
    return np.where(open_, sphere, metres)


def _geodesic(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for lat1, lon1, lat2, lon2 in parts:
        yield pd.Series(ellipsoidal_metres(*(x.to_numpy(float) for x in (lat1, lon1, lat2, lon2))))


def geodesic(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between places on the WGS84 ellipsoid, in Arrow batches."""
    return F.pandas_udf(_geodesic, "double")(lat1, lon1, lat2, lon2)


def world_region(lon: Column, lat: Column) -> Column:
    """Six parts of the world, by longitude breaks -31.5 and 60 and latitude breaks 12.5 (west) and 5.5 (east); 0 elsewhere."""
    west, middle, east = (lon >= -180) & (lon < -31.5), (lon >= -31.5) & (lon < 60), lon >= 60
    return (
        F.when(west & (lat >= 12.5), 0).when(middle & (lat >= 12.5), 1).when(east & (lat >= 5.5), 2)
        .when(west & (lat < 12.5), 3).when(middle & (lat < 12.5), 4).when(east & (lat < 5.5), 5).otherwise(0)
    )


def world_grid_cell(lon: Column, lat: Column, klon: int, klat: int) -> Column:
    """Cell of a regular klon x klat grid, numbered from the left top by rows; 9999 outside.

    Cells hold their upper latitude and their lower longitude.
    """
    if 360 % klon or 180 % klat:
        raise ValueError("klon must divide 360 and klat 180")
    row, col = F.floor((90 - lat) / (180 / klat)), F.floor((lon + 180) / (360 / klon))
    inside = (lat <= 90) & (lat > -90) & (lon >= -180) & (lon < 180)
    return F.when(inside, row * klon + col).otherwise(9999)


def meters_per_pixel(lat: Column, zoom: int) -> Column:
    return F.lit(PIXEL_AT_ZOOM_0) * F.cos(F.radians(lat)) / float(2**zoom)


def tile_half_sizes(lat: Column, zoom: int, pixels: int) -> tuple[Column, Column]:
    """Half width and half height, in degrees, of a tile of pixels x pixels centred at lat."""
    metres = meters_per_pixel(lat, zoom) * (pixels / 2)
    degree = math.pi * EARTH_RADIUS_M / 180
    return metres / (degree * F.cos(F.radians(lat))), metres / degree


def tile_vertices(lon: Column, lat: Column, zoom: int, pixels: int) -> Column:
    """Ring of a tile: NW, NE, SE, SW, NW."""
    w, h = tile_half_sizes(lat, zoom, pixels)
    return F.array(*[F.struct((lon + sx * w).alias("x"), (lat + sy * h).alias("y")) for sx, sy in ((-1, 1), (1, 1), (1, -1), (-1, -1), (-1, 1))])


def _edges(ring: Column) -> Column:
    return F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def edges(rings: Column) -> Column:
    """All edges (a, b) of all rings."""
    return F.flatten(F.transform(rings, _edges))


def inside(rings: Column, lon: Column, lat: Column) -> Column:
    """Whether a point lies strictly within a polygon (even-odd rule, so holes count); on an edge it does not."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > lat) != (b["y"] > lat)
        return spans & (lon < (b["x"] - a["x"]) * (lat - a["y"]) / (b["y"] - a["y"]) + a["x"])

    def touches(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = (b["x"] - a["x"]) * (lat - a["y"]) - (b["y"] - a["y"]) * (lon - a["x"])
        between = (lon >= F.least(a["x"], b["x"])) & (lon <= F.greatest(a["x"], b["x"])) & (lat >= F.least(a["y"], b["y"])) & (lat <= F.greatest(a["y"], b["y"]))
        return (cross == 0) & between

    every = edges(rings)
    return (F.size(F.filter(every, crosses)) % 2 == 1) & ~F.exists(every, touches)


def nearest_on_segment(a: Column, b: Column, lon: Column, lat: Column) -> Column:
    """Struct (d2, x, y): the place of a segment that is nearest to a point in the plane of degrees, and its squared distance there."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((lon - a["x"]) * dx + (lat - a["y"]) * dy) / length))).otherwise(0.0)
    x, y = a["x"] + t * dx, a["y"] + t * dy
    return F.struct(((x - lon) * (x - lon) + (y - lat) * (y - lat)).alias("d2"), x.alias("x"), y.alias("y"))


def meets_box(a: Column, b: Column, lon: Column, lat: Column, reach: float | Column) -> Column:
    """Whether a segment has a place within reach degrees of a point, in longitude and in latitude at once."""

    def along(c: str, at: Column) -> tuple[Column, Column, Column]:
        """The part of the segment, from 0 to 1, that is in reach along one axis."""
        d, lo, hi = b[c] - a[c], at - reach - a[c], at + reach - a[c]
        still = d == 0
        return F.when(still, 0.0).otherwise(F.least(lo / d, hi / d)), F.when(still, 1.0).otherwise(F.greatest(lo / d, hi / d)), ~still | ((lo <= 0) & (hi >= 0))

    (x0, x1, x), (y0, y1, y) = along("x", lon), along("y", lat)
    return x & y & (F.greatest(F.lit(0.0), x0, y0) <= F.least(F.lit(1.0), x1, y1))


def bbox(rings: Column) -> Column:
    """Struct (x0, y0, x1, y1)."""
    pts = F.flatten(rings)
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def equal_area_centroid(rings: Column) -> Column:
    """Struct (lon, lat) of the centroid in a cylindrical equal-area projection; a ring without area gives its mean vertex."""
    y = lambda p: F.sin(F.radians(p["y"]))
    cross = lambda e: e["a"]["x"] * y(e["b"]) - e["b"]["x"] * y(e["a"])
    total = lambda f: F.aggregate(F.transform(edges(rings), f), F.lit(0.0), lambda s, v: s + v)
    area2 = total(cross)
    cx, cy = total(lambda e: (e["a"]["x"] + e["b"]["x"]) * cross(e)) / (3 * area2), total(lambda e: (y(e["a"]) + y(e["b"])) * cross(e)) / (3 * area2)
    pts = F.flatten(rings)
    mean = lambda f: F.aggregate(F.transform(pts, f), F.lit(0.0), lambda s, v: s + v) / F.size(pts)
    flat = area2 == 0
    return F.struct(F.when(flat, mean(lambda p: p["x"])).otherwise(cx).alias("lon"), F.degrees(F.asin(F.when(flat, mean(y)).otherwise(cy))).alias("lat"))
