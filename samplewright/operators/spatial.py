"""Spatial joins and grids, in DataFrame functions.

points: (id, lon, lat); polygons: (polygon, rings), see functions.geo.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import LEAST_DEGREE_M, bbox, edges, geodesic, inside, meets_box, nearest_on_segment, tile_half_sizes
from ..functions.keys import tile_id
from ..prefix import BUCKET_ROWS
from ..stored import stored

#: Cells along a side of a box, about; a box gets the level of the grid at which it covers no more.
PARTS = 4
#: Points of a cell from which it is divided, if they are also this share of all; halvings of its sides then, and salts of its points at most.
CELL_POINTS, HOT_SHARE, DEPTH, SALTS = 20_000, 1 / 1000, 3, 32
KEYS = ["level", "cx", "cy", "sx", "sy", "salt"]
#: Coordinates of an axis that are sent to all tasks at most.
AXIS_ROWS = 1 << 20


def in_cells(shapes: DataFrame, box: Sequence[Column], cell: float) -> DataFrame:
    """Adds level, cx and cy: the grid cells that the box (x0, y0, x1, y1) covers.

    Cells of a level are twice as wide as those of the level below, so that every
    box, whatever its size, covers at most (PARTS + 1) squared of them.
    """
    x0, y0, x1, y1 = box
    size = F.greatest(x1 - x0, y1 - y0)
    level = F.when(size > cell * PARTS, F.ceil(F.log2(size / (cell * PARTS)))).otherwise(0).cast("int")
    own = shapes.withColumns({"level": level, "_x0": x0, "_y0": y0, "_x1": x1, "_y1": y1}).withColumn("_s", cell * F.pow(F.lit(2.0), "level"))
    span = lambda c: F.explode(F.sequence(F.floor(F.col(f"_{c}0") / F.col("_s")), F.floor(F.col(f"_{c}1") / F.col("_s"))))
    return own.withColumn("cx", span("x")).withColumn("cy", span("y")).drop("_s", "_x0", "_y0", "_x1", "_y1")


def at_cells(points: DataFrame, levels: Sequence[int], cell: float) -> DataFrame:
    """Adds level, cx and cy: the cell that holds the point at each of the levels, of which there are as many as doublings of the cell."""
    own = points.withColumn("level", F.explode(F.array(*[F.lit(int(x)) for x in levels]).cast("array<int>")))
    size = cell * F.pow(F.lit(2.0), "level")
    return own.withColumns({"cx": F.floor(F.col("lon") / size), "cy": F.floor(F.col("lat") / size)})


def _meeting(points: DataFrame, shapes: DataFrame, cell: float, widest: float | None = None) -> DataFrame:
    """points joined to the shapes (with level, cx, cy) whose box covers their cell: an equi-join.

    widest: the size of the largest box, where it is known; else the levels are looked up.
    """
    if widest is None:
        levels = [r["level"] for r in shapes.select("level").distinct().collect()]  # a row for each doubling of the cell
    else:
        levels = range(1 + (math.ceil(math.log2(widest / (cell * PARTS)) + 1e-9) if widest > cell * PARTS else 0))
    return at_cells(points.select("id", "lon", "lat"), levels, cell).join(shapes, ["level", "cx", "cy"]).drop("level", "cx", "cy")


def divided(points: DataFrame, shapes: DataFrame, cell: float, levels: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """points (id, lon, lat) and shapes (with level, cx, cy and box b), both with the keys KEYS on which they meet.

    A cell with more than CELL_POINTS points, and more than HOT_SHARE of all, is
    divided DEPTH times into quarters, and its points are dealt to as many salts as
    it has times that many points; its shapes go to the quarters that their boxes
    meet, once for each salt. Such cells are at most 1 / HOT_SHARE a level.
    """
    own, n = at_cells(points.select("id", "lon", "lat"), levels, cell), points.count()
    floor = max(CELL_POINTS, math.ceil(n * HOT_SHARE))
    if n <= floor:  # no cell can hold more
        alone = {"sx": F.lit(0).cast("bigint"), "sy": F.lit(0).cast("bigint"), "salt": F.lit(-1).cast("bigint")}
        return own.withColumns(alone), shapes.withColumns(alone)
    crowded = own.groupBy("level", "cx", "cy").agg(F.count("*").alias("_n")).filter(F.col("_n") > floor)
    crowded = F.broadcast(crowded.select("level", "cx", "cy", F.least(F.lit(SALTS), F.ceil(F.col("_n") / floor).cast("int")).alias("salts")))
    part, k = cell * F.pow(F.lit(2.0), "level") / 2**DEPTH, 2**DEPTH
    within = lambda v, c: F.greatest(F.col(c) * k, F.least(F.col(c) * k + k - 1, F.floor(v / part)))
    hot = F.col("salts").isNotNull()
    own = own.join(crowded, ["level", "cx", "cy"], "left").withColumns({"sx": F.when(hot, within(F.col("lon"), "cx")), "sy": F.when(hot, within(F.col("lat"), "cy"))})
    own = own.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("id"), F.col("salts"))))
    met = shapes.join(crowded, ["level", "cx", "cy"], "left")
    none = lambda kind: F.array(F.lit(None).cast(kind))
    for c, lo, hi in (("sx", "x0", "x1"), ("sy", "y0", "y1")):
        span = F.sequence(within(F.col("b")[lo], f"c{c[1]}"), within(F.col("b")[hi], f"c{c[1]}"))
        met = met.withColumn(c, F.explode(F.when(hot, span).otherwise(none("bigint"))))
    met = met.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0).cast("bigint"), F.col("salts").cast("bigint") - 1)).otherwise(none("bigint"))))
    plain = {c: F.coalesce(F.col(c), F.lit(-1).cast("bigint")) for c in ("salt",)} | {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in ("sx", "sy")}
    return own.withColumns(plain).drop("salts"), met.withColumns(plain).drop("salts")


def points_within_polygons(points: DataFrame, polygons: DataFrame, cell: float = 1.0) -> DataFrame:
    """Left spatial join: adds polygon, the least one that strictly holds the point, or null.

    Polygons are dealt to the grid cells of their boxes, at the level that suits
    their size, and meet the points of a cell by an equi-join; crowded cells are
    divided. Where a cell lies wholly within a polygon, its points are held without
    a look at the edges; in the other cells the exact test follows.
    """
    b = F.col("b")
    boxed = polygons.select("polygon", "rings", bbox(F.col("rings")).alias("b"))
    celled = in_cells(boxed, [b["x0"], b["y0"], b["x1"], b["y1"]], cell)
    levels = [r["level"] for r in celled.select("level").distinct().collect()]  # a row for each doubling of the cell
    own, met = divided(points, celled, cell, levels)
    # the square of the key: a quarter of a divided cell, or the cell
    side = cell * F.pow(F.lit(2.0), "level") / F.when(F.col("salt") >= 0, 2**DEPTH).otherwise(1)
    at = {c: (F.when(F.col("salt") >= 0, F.col(f"s{c}")).otherwise(F.col(f"c{c}")) + 0.5) * side for c in "xy"}
    met = met.withColumns({"_x": at["x"], "_y": at["y"], "_half": side / 2 * (1 + 1e-6)})
    cut = F.exists(edges(F.col("rings")), lambda e: meets_box(e["a"], e["b"], F.col("_x"), F.col("_y"), F.col("_half")))
    met = met.withColumn("whole", ~cut & inside(F.col("rings"), F.col("_x"), F.col("_y"))).withColumn("rings", F.when(~F.col("whole"), F.col("rings")))
    near = own.join(met.drop("_x", "_y", "_half"), KEYS)
    exact = F.col("lon").between(b["x0"], b["x1"]) & F.col("lat").between(b["y0"], b["y1"]) & inside(F.col("rings"), F.col("lon"), F.col("lat"))
    hit = near.filter(F.when(F.col("whole"), F.lit(True)).otherwise(exact)).groupBy("id").agg(F.min("polygon").alias("polygon"))
    return points.join(hit, "id", "left")


def nearest_polygon(points: DataFrame, polygons: DataFrame, reach: float = 0.5, outside: bool = False) -> DataFrame:
    """(id, polygon, metres): the polygon of least distance among those that come within reach degrees in both directions, among all if there are none.

    The distance to a polygon is the geodesic on the WGS84 ellipsoid to its place
    that is nearest in the plane of degrees, cut open opposite the point: polygons
    beyond the date line are near. A polygon that holds the point is at distance
    0 (outside: it is known that none does); of equally near ones the least is taken. Edges are dealt to the grid cells
    of their boxes, widened by the reach, and meet the points of a cell by an
    equi-join. Points without any edge in reach are taken again with four times
    the reach, until what they found is nearer than all that lies out of reach: as
    many passes as quadruplings.
    """
    own = points.select("id", "lon", "lat")
    held = None if outside else points_within_polygons(own, polygons).filter("polygon is not null").select("id", "polygon", F.lit(0.0).alias("metres"))
    segments = stored(polygons.select("polygon", F.explode(edges(F.col("rings"))).alias("e")).select("polygon", "e.a", "e.b"), "edges")
    x, y = ([F.col(f"{p}.{c}") for p in "ab"] for c in "xy")
    widest = segments.agg(F.max(F.greatest(F.abs(x[0] - x[1]), F.abs(y[0] - y[1]))).alias("w")).first()["w"] or 0.0

    def within(open_: DataFrame, far: float) -> DataFrame:
        wide = far * math.sqrt(2)  # a polygon in the box may have its nearest place outside, no farther than the corners
        box = [F.least(*x) - wide, F.least(*y) - wide, F.greatest(*x) + wide, F.greatest(*y) + wide]
        turned = F.filter(F.transform(F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0)), lambda t: F.col("lon") + t), lambda v: (v >= -180 - wide) & (v <= 180 + wide))
        copies = open_.select("id", F.explode(turned).alias("lon"), "lat")
        met = _meeting(copies, in_cells(segments, box, 2 * wide), 2 * wide, widest + 2 * wide)
        a, b, lon, lat = (F.col(c) for c in ("a", "b", "lon", "lat"))
        place = nearest_on_segment(a, b, lon, lat)
        near = met.select("id", "polygon", "lon", "lat", meets_box(a, b, lon, lat, far).alias("close"), place.alias("p"))
        # of the copies of a point, the one that sees the polygon nearest
        best = near.groupBy("id", "polygon").agg(F.max("close").alias("close"), F.min(F.struct("p.d2", "p.x", "p.y", "lon", "lat")).alias("p")).filter("close")
        metres = geodesic(F.col("p.lat"), F.col("p.lon"), F.col("p.y"), F.col("p.x"))
        return best.withColumn("metres", metres).groupBy("id").agg(F.min(F.struct("metres", "polygon")).alias("r")).select("id", "r.polygon", "r.metres")

    rest = stored(own if outside else own.join(held, "id", "left_anti"), "unmatched")
    first = stored(within(rest, reach), "nearest")
    out, open_, far = first if outside else held.unionByName(first), rest.join(first, "id", "left_anti"), reach
    while not segments.isEmpty():
        open_ = stored(open_, "unmatched")
        if open_.isEmpty():
            break
        far *= 4
        found = stored(within(open_, far).join(open_.select("id", "lat"), "id"), "nearest")
        # what lies out of reach is at least this far, going north or south, or east or west to another meridian
        aside = F.degrees(F.asin(F.cos(F.radians("lat")) * math.sin(math.radians(min(far, 90.0)))))
        sure = found.filter(F.col("metres") <= LEAST_DEGREE_M * 0.99 * F.least(F.lit(far), aside)) if far < 360 else found
        out = out.unionByName(sure.drop("lat"))
        open_ = open_.join(sure, "id", "left_anti")
    return out


def polygon_or_nearest(points: DataFrame, polygons: DataFrame, cell: float = 1.0) -> DataFrame:
    """Every point with its polygon: that which holds it, else the nearest."""
    found = stored(points_within_polygons(points, polygons, cell), "within")
    rest = nearest_polygon(found.filter("polygon is null"), polygons, outside=True).select("id", F.col("polygon").alias("_near"))
    return found.join(rest, "id", "left").withColumn("polygon", F.coalesce("polygon", "_near")).drop("_near")


def land_filter(grid: DataFrame, land: DataFrame, cell: float = 1.0) -> DataFrame:
    """Grid points over a land polygon."""
    return points_within_polygons(grid, land, cell).filter("polygon is not null").drop("polygon")


def _half_step(lo: float, hi: float, n: int) -> float:
    return (hi - lo) / (n - 1) / 2 if n > 1 else 0.0


def _by_search(points: DataFrame, axes: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """points with the index of the nearest coordinate of each axis, by binary search in the sorted axes, which go to all tasks."""
    known = {}
    for out, (column, axis) in axes.items():
        got = axis.select(F.col("coord").cast("double").alias("c"), F.col("idx").cast("int").alias("i")).orderBy("c", "i").toArrow()
        known[out] = column, got.column("c").to_numpy(), got.column("i").to_numpy()
    shared = points.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, names = list(b.columns), list(b.schema.names)
            for out, (column, coord, idx) in shared.value.items():
                v = b.column(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
                if len(coord):
                    at = np.clip(np.searchsorted(coord, v), 1, max(1, len(coord) - 1))
                    lo, hi = at - 1, np.minimum(at, len(coord) - 1)
                    near = np.where(v - coord[lo] <= coord[hi] - v, lo, hi)
                    near = np.searchsorted(coord, coord[near])  # the first of equal coordinates
                    half = _half_step(coord[0], coord[-1], len(coord))
                    cols.append(pa.array(idx[near], pa.int32(), mask=~((v >= coord[0] - half) & (v <= coord[-1] + half))))
                else:
                    cols.append(pa.nulls(b.num_rows, pa.int32()))
                names.append(out)
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = ", ".join([*(f"`{c}` {t}" for c, t in points.dtypes), *(f"{c} int" for c in axes)])
    return points.mapInArrow(run, schema)


def _by_ranges(values: DataFrame, axis: DataFrame) -> DataFrame:
    """(id, idx) of the nearest coordinate to (id, v), for an axis of any length.

    Values and coordinates are cut together into ranges of about BUCKET_ROWS rows,
    whatever their density; in a range, windows give the last coordinate before and
    the first after, and where it holds none on a side, the ranges' own ends carry
    the nearest one over the edge.
    """
    first = axis.groupBy(F.col("coord").cast("double").alias("v")).agg(F.min("idx").alias("idx"))
    marks = first.select("v", F.struct(F.col("v").alias("coord"), "idx").alias("c"))
    both = values.select("id", F.col("v").cast("double").alias("v")).filter("v is not null and not isnan(v)").unionByName(marks, allowMissingColumns=True)
    both = stored(both, "axis")
    n = max(1, math.ceil(both.count() / BUCKET_ROWS))
    dealt = stored(both.withColumn("h", F.xxhash64("id")).repartitionByRange(n, "v", "h").withColumn("_range", F.spark_partition_id()), "axis-ranges")
    ends = dealt.groupBy("_range").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))  # a row for each range
    before, after = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    carried = ends.select("_range", F.last("hi", ignorenulls=True).over(before).alias("_back"), F.first("lo", ignorenulls=True).over(after).alias("_ahead"))
    place = Window.partitionBy("_range").orderBy("v", F.col("c").isNull())
    near = dealt.withColumn("lo", F.last("c", ignorenulls=True).over(place.rowsBetween(Window.unboundedPreceding, 0)))
    near = near.withColumn("hi", F.first("c", ignorenulls=True).over(place.rowsBetween(0, Window.unboundedFollowing))).filter("c is null")
    near = near.join(carried, "_range").withColumns({"lo": F.coalesce("lo", "_back"), "hi": F.coalesce("hi", "_ahead")})
    bounds = axis.agg(F.min("coord").alias("a"), F.max("coord").alias("z"), F.count("*").alias("n"))  # one row
    half = F.when(F.col("n") > 1, (F.col("z") - F.col("a")) / (F.col("n") - 1) / 2).otherwise(0.0)
    down = F.col("lo").isNotNull() & (F.col("hi").isNull() | (F.col("v") - F.col("lo.coord") <= F.col("hi.coord") - F.col("v")))
    outside = (F.col("v") < F.col("a") - half) | (F.col("v") > F.col("z") + half)
    return near.join(F.broadcast(bounds)).select("id", F.when(~outside, F.when(down, F.col("lo.idx")).otherwise(F.col("hi.idx"))).alias("idx"))


def nearest_grid_index(points: DataFrame, lon_axis: DataFrame, lat_axis: DataFrame) -> DataFrame:
    """Adds i and j, 1-based indices of the nearest grid coordinates, the lower on ties; null over half a step outside the grid.

    Axes of up to AXIS_ROWS coordinates are searched in every task, and points are
    not shuffled; longer ones are joined as ranges.
    """
    if max(axis.count() for axis in (lon_axis, lat_axis)) <= AXIS_ROWS:
        return _by_search(points, {"i": ("lon", lon_axis), "j": ("lat", lat_axis)})
    i = _by_ranges(points.select("id", F.col("lon").alias("v")), lon_axis).withColumnRenamed("idx", "i")
    j = _by_ranges(points.select("id", F.col("lat").alias("v")), lat_axis).withColumnRenamed("idx", "j")
    return points.join(i, "id", "left").join(j, "id", "left")


def grid_centroid(rows: DataFrame, lon_axis: DataFrame, lat_axis: DataFrame, id_col: str = "id") -> DataFrame:
    """Adds lon and lat of ids 'i,j'."""
    parts = F.split(F.col(id_col), ",")
    own = rows.withColumn("_i", parts[0].cast("int")).withColumn("_j", parts[1].cast("int"))
    lon, lat = lon_axis.select(F.col("idx").alias("_i"), F.col("coord").alias("lon")), lat_axis.select(F.col("idx").alias("_j"), F.col("coord").alias("lat"))
    return own.join(lon, "_i", "left").join(lat, "_j", "left").drop("_i", "_j")


def make_grid(spark: SparkSession, zoom: int, pixels: int, west: float, east: float, south: float, north: float) -> tuple[DataFrame, DataFrame]:
    """(lon_axis, lat_axis) of (idx, coord): equal steps in longitude; each latitude lies a tile's height below the one before.

    A tile's height in degrees is its width times cos(lat), so latitudes follow a recurrence.
    """
    step = spark.range(1).select((2 * tile_half_sizes(F.lit(0.0), zoom, pixels)[0]).alias("w")).first()["w"]
    n = int((east - west) / step)
    lon = spark.range(n + 1).select((F.col("id") + 1).cast("int").alias("idx"), (F.lit(west) + F.col("id") * step).alias("coord"))
    lat = spark.sql(
        f"""WITH RECURSIVE t(idx, coord) MAX RECURSION LEVEL 1000000 AS (
              SELECT 1, CAST({north!r} AS DOUBLE)
              UNION ALL SELECT idx + 1, coord - {step!r}D * cos(radians(coord)) FROM t WHERE coord - {step!r}D * cos(radians(coord)) >= {south!r}D)
            SELECT idx, coord FROM t"""
    )
    return lon, lat


def tile_class_lookup(pixels: DataFrame, raster: DataFrame, west: float, north: float, step: float) -> DataFrame:
    """Adds class: that of the raster cell (row, col) under each pixel's lon and lat; null outside."""
    own = pixels.withColumns({"_row": F.floor((F.lit(north) - F.col("lat")) / step), "_col": F.floor((F.col("lon") - F.lit(west)) / step)})
    cells = raster.select(F.col("row").alias("_row"), F.col("col").alias("_col"), "class")
    return own.join(cells, ["_row", "_col"], "left").drop("_row", "_col")


def attach_tile_location(tiles: DataFrame, places: DataFrame, lon_axis: DataFrame, lat_axis: DataFrame) -> DataFrame:
    """tiles (name, ...) with id, lon, lat and the grid id 'i,j'."""
    own = tiles.withColumn("id", tile_id(F.col("name"))).join(places.select("id", "lon", "lat"), "id", "left")
    located = nearest_grid_index(own, lon_axis, lat_axis)
    return located.withColumn("grid_id", F.when(F.col("i").isNotNull() & F.col("j").isNotNull(), F.concat_ws(",", "i", "j"))).drop("i", "j")


