"""Measures on coordinates and rings, as Column expressions.

A ring is an array of structs (x, y) whose last vertex repeats the first;
longitudes are x, latitudes y, in degrees.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6_378_137.0
TILE_PIXELS = 256
PIXEL_ZOOM = 21


def central_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The angle between two places at the Earth's centre, by haversines."""
    a = F.pow(F.sin((F.radians(y2) - F.radians(y1)) / 2), 2) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(F.sin((F.radians(x2) - F.radians(x1)) / 2), 2)
    return 2 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def sphere_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Metres along the sphere."""
    return central_angle(x1, y1, x2, y2) * EARTH_RADIUS


def azimuth(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees clockwise from north of the plane direction to the second place."""
    return F.pmod(F.degrees(F.atan2(x2 - x1, y2 - y1)), F.lit(360.0))


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Plane distance from a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    t = F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / size)))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def shoelace(ring: Column) -> Column:
    """Signed plane area of a ring, in square degrees; counter-clockwise is positive."""
    ahead = F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0)))
    behind = F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))
    crosses = F.zip_with(behind, ahead, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(crosses, F.lit(0.0), lambda s, v: s + v) / 2


def centroid(ring: Column) -> Column:
    """Struct x, y: the centre of a ring's area; of a ring without area, the mean of its vertices."""
    n = F.size(ring) - 1
    ahead, behind = F.slice(ring, 2, F.greatest(n, F.lit(0))), F.slice(ring, 1, F.greatest(n, F.lit(0)))
    area = shoelace(ring)

    def moment(c: str) -> Column:
        parts = F.zip_with(behind, ahead, lambda a, b: (a[c] + b[c]) * (a["x"] * b["y"] - b["x"] * a["y"]))
        mean = F.aggregate(behind, F.lit(0.0), lambda s, v: s + v[c]) / n
        return F.when(area != 0, F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / (6 * area)).otherwise(mean)

    return F.struct(moment("x").alias("x"), moment("y").alias("y"))


def spherical_ring_area(ring: Column) -> Column:
    """Square metres of a ring on the sphere: signed triangles from the first vertex, their excess by l'Huilier; absolute."""
    first = F.get(ring, 0)
    pairs = F.arrays_zip(F.slice(ring, 2, F.greatest(F.size(ring) - 2, F.lit(0))).alias("a"), F.slice(ring, 3, F.greatest(F.size(ring) - 2, F.lit(0))).alias("b"))

    def triangle(p: Column) -> Column:
        sides = [central_angle(u["x"], u["y"], v["x"], v["y"]) for u, v in ((first, p["a"]), (p["a"], p["b"]), (p["b"], first))]
        half = (sides[0] + sides[1] + sides[2]) / 2
        inside = F.tan(half / 2)
        for s in sides:
            inside = inside * F.tan(F.greatest(half - s, F.lit(0.0)) / 2)
        return turn(first, p["a"], p["b"]) * 4 * F.atan(F.sqrt(F.greatest(inside, F.lit(0.0))))

    return F.abs(F.aggregate(F.filter(pairs, lambda p: p["b"].isNotNull()), F.lit(0.0), lambda s, p: s + triangle(p))) * EARTH_RADIUS**2


def turn(a: Column, b: Column, c: Column) -> Column:
    """The sign of the triple product of three places' unit vectors."""
    u, v, w = [(F.cos(F.radians(p["y"])) * F.cos(F.radians(p["x"])), F.cos(F.radians(p["y"])) * F.sin(F.radians(p["x"])), F.sin(F.radians(p["y"]))) for p in (a, b, c)]
    return F.signum(u[0] * (v[1] * w[2] - v[2] * w[1]) - u[1] * (v[0] * w[2] - v[2] * w[0]) + u[2] * (v[0] * w[1] - v[1] * w[0]))


def cell_area(resolution: float, latitude: Column) -> Column:
    """Square kilometres of a lattice cell whose southern or northern edge is at a latitude: that of its row of the lattice."""
    row = F.floor(F.abs(latitude) / resolution) * resolution
    band = F.sin(F.radians(row + resolution)) - F.sin(F.radians(row))
    return F.radians(F.lit(resolution)) * band * (EARTH_RADIUS / 1000) ** 2


def metres_per_pixel(latitude: Column, zoom: int) -> Column:
    return F.cos(F.radians(latitude)) * (2 * math.pi * EARTH_RADIUS) / (TILE_PIXELS << zoom)


def mercator_x(x: Column) -> Column:
    """Web Mercator metres of a longitude."""
    return x * (math.pi * EARTH_RADIUS / 180)


def mercator_y(y: Column) -> Column:
    """Web Mercator metres of a latitude."""
    return F.log(F.tan(F.radians((y + 90) / 2))) * EARTH_RADIUS


def longitude(mx: Column) -> Column:
    return mx / (math.pi * EARTH_RADIUS / 180)


def latitude(my: Column) -> Column:
    return F.degrees(F.atan(F.exp(my / EARTH_RADIUS))) * 2 - 90


def pixel_x(x: Column, zoom: int = PIXEL_ZOOM) -> Column:
    half = (TILE_PIXELS << zoom) / 2
    return F.round(half + x * (half / 180)).cast("long")


def pixel_y(y: Column, zoom: int = PIXEL_ZOOM) -> Column:
    half = (TILE_PIXELS << zoom) / 2
    s = F.sin(F.radians(y))
    return F.round(half - half / math.pi * F.log((1 + s) / (1 - s)) / 2).cast("long")


def pixel_distance(x1: Column, y1: Column, x2: Column, y2: Column, zoom: int) -> Column:
    """Whole pixels between two places at a zoom level."""
    dx, dy = pixel_x(x1) - pixel_x(x2), pixel_y(y1) - pixel_y(y2)
    return F.shiftright(F.floor(F.sqrt(dx * dx + dy * dy)).cast("long"), PIXEL_ZOOM - zoom)


def clamped_ring(ring: Column) -> Column:
    """A ring with longitudes within 180 and latitudes within 90 degrees, closed if it wasn't."""
    inside = F.transform(ring, lambda v: F.struct(F.greatest(F.lit(-180.0), F.least(F.lit(180.0), v["x"])).alias("x"), F.greatest(F.lit(-90.0), F.least(F.lit(90.0), v["y"])).alias("y")))
    first = F.get(inside, 0)
    return F.when(first == F.get(inside, F.size(inside) - 1), inside).otherwise(F.concat(inside, F.array(first)))


def circle(x: Column, y: Column, metres: Column, points: int = 360) -> Column:
    """A closed ring at a distance around a place; moved east by 360 degrees if it crosses the western end."""
    angle = metres / EARTH_RADIUS

    def at(k: Column) -> Column:
        bearing = F.radians(k * (360.0 / points))
        north = F.asin(F.sin(F.radians(y)) * F.cos(angle) + F.cos(F.radians(y)) * F.sin(angle) * F.cos(bearing))
        east = F.radians(x) + F.atan2(F.sin(bearing) * F.sin(angle) * F.cos(F.radians(y)), F.cos(angle) - F.sin(F.radians(y)) * F.sin(north))
        return F.struct(F.degrees(east).alias("x"), F.degrees(north).alias("y"))

    ring = F.transform(F.sequence(F.lit(0), F.lit(points)), lambda k: at(k % points))
    west = F.exists(ring, lambda p: p["x"] < -180)
    return F.transform(ring, lambda p: F.struct((p["x"] + F.when(west, 360.0).otherwise(0.0)).alias("x"), p["y"].alias("y")))
