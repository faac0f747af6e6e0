"""A grid over the earth: points near each other share a cell or lie in neighbouring ones, so that distances need no product of all points.

Rows are bands of latitude as high as the distance; a row has as many columns as its distance allows at the latitude farthest from the equator that a
neighbour can have. One side of a join keeps its own cell, the other is repeated for the cells within reach, nine at most; the exact distance decides last.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.geo import EARTH_KM, EARTH_M, haversine_km

#: Room for rounding, as a share of the distance.
SLACK = 1 + 1e-9


def _height(metres: float) -> float:
    """Degrees of latitude of a row."""
    return min(180.0, math.degrees(metres * SLACK / EARTH_M))


def row_of(lat: Column, metres: float) -> Column:
    return F.floor((lat + 90) / _height(metres)).cast("bigint")


def _reach(row: Column, metres: float) -> Column:
    """Degrees of longitude that a point in a row can be away from one within the distance, 360 near the poles."""
    height = _height(metres)
    # the farthest latitude of the row and its neighbours
    far = F.greatest(F.abs((row - 1) * height - 90), F.abs((row + 2) * height - 90))
    half = F.lit(math.sin(min(math.pi / 2, metres * SLACK / (2 * EARTH_M)))) / F.cos(F.radians(F.least(far, F.lit(89.999))))
    return F.when((far >= 89.9) | (half >= 0.5), F.lit(360.0)).otherwise(F.degrees(2 * F.asin(F.least(half, F.lit(1.0)))) * SLACK)


def _columns(row: Column, metres: float) -> Column:
    return F.greatest(F.lit(1), F.floor(360 / _reach(row, metres))).cast("bigint")


def _column(lng: Column, row: Column, metres: float) -> Column:
    n = _columns(row, metres)
    return F.pmod(F.floor(F.pmod(lng + 180, F.lit(360.0)) * n / 360).cast("bigint"), n)


def cell(lat: Column, lng: Column, metres: float) -> Column:
    """The cell of a point, null for one without coordinates."""
    row = row_of(lat, metres)
    known = lat.between(-90, 90) & lng.isNotNull() & ~F.isnan(lng) & (F.abs(lng) <= 540)
    return F.when(known, F.struct(row.alias("r"), _column(lng, row, metres).alias("c")))


def cells_around(lat: Column, lng: Column, metres: float) -> Column:
    """The cells in which points within the distance lie, each once; an empty array for a point without coordinates."""
    own = row_of(lat, metres)

    def of_row(step: Column) -> Column:
        row = own + step
        # three columns reach far enough, as one is as wide as the distance in the row's farthest latitude
        n, c = _columns(row, metres), _column(lng, row, metres)
        return F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.struct(row.alias("r"), F.pmod(c + k, n).alias("c")))

    known = lat.between(-90, 90) & lng.isNotNull() & ~F.isnan(lng) & (F.abs(lng) <= 540)
    found = F.array_distinct(F.flatten(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), of_row)))
    return F.when(known, found).otherwise(F.filter(found, lambda _: F.lit(False)))


def cells_touched(lat: Column, lng: Column, metres: float, size: float) -> Column:
    """The cells of a grid for `size` >= metres in which points within `metres` lie, each once: mostly one."""
    up = math.degrees(metres * SLACK / EARTH_M)

    def of_row(row: Column) -> Column:
        height = _height(size)
        far = F.least(F.greatest(F.abs((row - 1) * height - 90), F.abs((row + 2) * height - 90)), F.lit(89.999))
        half = F.lit(math.sin(min(math.pi / 2, metres * SLACK / (2 * EARTH_M)))) / F.cos(F.radians(far))
        # no wider than a column, unless the row has one column only
        wide = F.degrees(2 * F.asin(F.least(half, F.lit(1.0)))) * SLACK
        return F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.struct(row.alias("r"), _column(lng + k * wide, row, size).alias("c")))

    known = lat.between(-90, 90) & lng.isNotNull() & ~F.isnan(lng) & (F.abs(lng) <= 540)
    rows = F.array_distinct(F.array(row_of(lat - up, size), row_of(lat, size), row_of(lat + up, size)))
    found = F.array_distinct(F.flatten(F.transform(rows, of_row)))
    return F.when(known, found).otherwise(F.filter(found, lambda _: F.lit(False)))


def nearest_on_grid(points: DataFrame, centres: DataFrame, key: str) -> DataFrame:
    """(key, centre, km): the closest centre within its own radius, the earlier one of equals, else null; any number of centres.

    centres: position, centre, lat, lng, radius_km. Centres are sorted into classes of radii by powers of two, each with a grid of its own; a point
    has one cell a class, and there are a few dozen classes at most, as radii lie between millimetres and half of the earth.
    """
    sized = centres.where("radius_km >= 0").withColumn("k", F.greatest(F.lit(-20), F.least(F.lit(15), F.ceil(F.log2(F.greatest("radius_km", F.lit(1e-9)))).cast("int"))))
    classes = sorted(r["k"] for r in sized.select("k").distinct().collect())  # 36 at most
    p = points.select(F.col(key).alias("p"), F.col("lat").alias("plat"), F.col("lng").alias("plng"))
    near = []
    for k in classes:
        metres = 2.0**k * 1000
        around = sized.where(F.col("k") == k).select("position", "centre", "lat", "lng", "radius_km", F.explode(cells_around(F.col("lat"), F.col("lng"), metres)).alias("cell"))
        near.append(p.withColumn("at", cell(F.col("plat"), F.col("plng"), metres)).join(around, F.col("at") == F.col("cell")).withColumn("km", haversine_km(F.col("plat"), F.col("plng"), F.col("lat"), F.col("lng"))).where("km <= radius_km").groupBy("p").agg(F.min(F.struct("km", "position", "centre")).alias("b")))
    if not near:
        return points.select(key, F.lit(None).cast("string").alias("centre"), F.lit(None).cast("double").alias("km"))
    found = near[0]
    for more in near[1:]:
        found = found.unionByName(more)
    best = found.groupBy("p").agg(F.min("b").alias("b"))
    return points.select(key).join(best, F.col(key) == F.col("p"), "left").select(key, F.col("b.centre").alias("centre"), F.round("b.km", 6).alias("km"))


#: Largest distance on the earth, in metres.
HALF_EARTH_M = math.pi * EARTH_KM * 1000
