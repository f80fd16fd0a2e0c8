"""Joins of points with polygons.

A polygon layer is a table of ring vertices (oid, part, ring, i, x, y). For
joins each object becomes one row: its bounding box, and per part the array of
its edges, so that a candidate pair is decided in one expression, without a row
per edge and without a shuffle after the join. Candidates meet by lattice cell:
the box's cells are exploded on one side, the point's cell computed on the
other, which makes the join an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafacet.functions import measure
from terrafacet.session import settle

CELL = 2.0
PIXEL_CELL = float(1 << 21)  # some one and a half degrees at the equator


def shapes(rings: DataFrame) -> DataFrame:
    """oid, parts (arrays of edges x1, y1, x2, y2) and the box x0, y0, x9, y9 of each object."""
    ordered = F.array_sort(F.collect_list(F.struct("i", "x", "y")))
    one = rings.groupBy("oid", "part", "ring").agg(ordered.alias("v"))
    ahead = F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0)))
    behind = F.slice("v", 1, F.greatest(F.size("v") - 1, F.lit(0)))
    edges = F.zip_with(behind, ahead, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    box = [F.array_min(F.transform("v", lambda p: p[c])).alias(f"{c}0") for c in "xy"] + [F.array_max(F.transform("v", lambda p: p[c])).alias(f"{c}9") for c in "xy"]
    with_edges = one.select("oid", "part", edges.alias("edges"), *box)
    parts = with_edges.groupBy("oid", "part").agg(F.flatten(F.collect_list("edges")).alias("edges"), *bounds())
    return parts.groupBy("oid").agg(F.collect_list("edges").alias("parts"), *bounds())


def bounds() -> list[Column]:
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x9").alias("x9"), F.max("y9").alias("y9")]


def inside_part(edges: Column, px: Column, py: Column) -> Column:
    """Even-odd test with a ray to the north; points on an edge or a vertex are inside."""

    def straddles(e: Column) -> Column:
        return (e["x1"] > px) != (e["x2"] > px)

    def height(e: Column) -> Column:
        return (px - e["x2"]) * ((e["y2"] - e["y1"]) / (e["x2"] - e["x1"])) + e["y2"]

    above = F.size(F.filter(edges, lambda e: straddles(e) & (height(e) > py)))
    touches = F.exists(edges, lambda e: (straddles(e) & (height(e) == py)) | ((e["x1"] == px) & (e["y1"] == py)))
    return (above % 2 == 1) | touches


def inside(parts: Column, px: Column, py: Column) -> Column:
    """Inside any part."""
    return F.exists(parts, lambda edges: inside_part(edges, px, py))


def cells_of(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor(low / cell), F.floor(high / cell))


def candidates(points: DataFrame, shape: DataFrame, cell: float = CELL, margin: float = 0.0) -> DataFrame:
    """Pairs of a point (pt, x, y) and an object whose box, grown by `margin`, holds it.

    A cell takes along only edges that matter to its points: in `parts` those over
    its column that don't end south of it, for a ray to the north, and in `close`
    those within `margin` of it.
    """
    slack = cell * 1e-6  # a place on the border of a cell may be rounded into it
    east_west = lambda e: [F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])]
    north_south = lambda e: [F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])]

    def meets(ends: list[Column], k: Column, by: float) -> Column:
        return (ends[0] <= (k + 1) * cell + by) & (ends[1] >= k * cell - by)

    kx, ky = F.col("kx"), F.col("ky")
    grown = shape.withColumn("kx", F.explode(cells_of(F.col("x0") - margin, F.col("x9") + margin, cell)))
    grown = grown.withColumn("close", F.filter(F.flatten("parts"), lambda e: meets(east_west(e), kx, margin + slack)))
    grown = grown.withColumn("parts", F.transform("parts", lambda part: F.filter(part, lambda e: meets(east_west(e), kx, slack))))
    grown = grown.withColumn("ky", F.explode(cells_of(F.col("y0") - margin, F.col("y9") + margin, cell)))
    grown = grown.withColumn("close", F.filter("close", lambda e: meets(north_south(e), ky, margin + slack)))
    grown = grown.withColumn("parts", F.transform("parts", lambda part: F.filter(part, lambda e: north_south(e)[1] >= ky * cell - slack)))
    keyed = points.withColumn("kx", F.floor(F.col("x") / cell)).withColumn("ky", F.floor(F.col("y") / cell))
    near = keyed.join(grown, ["kx", "ky"])
    in_box = F.col("x").between(F.col("x0") - margin, F.col("x9") + margin) & F.col("y").between(F.col("y0") - margin, F.col("y9") + margin)
    return near.where(in_box).drop("kx", "ky")


def contains(points: DataFrame, rings: DataFrame, cell: float = CELL) -> DataFrame:
    """pt and oid of every point inside an object. Points without coordinates are in none."""
    pairs = candidates(points.select("pt", "x", "y"), shapes(rings), cell)
    return pairs.where(inside(F.col("parts"), F.col("x"), F.col("y"))).select("pt", "oid")


def contains_in_pixels(points: DataFrame, rings: DataFrame) -> DataFrame:
    """As contains, over whole Web Mercator pixels."""
    pixels = {"x": measure.pixel_x(F.col("x")).cast("double"), "y": measure.pixel_y(F.col("y")).cast("double")}
    return contains(points.withColumns(pixels), rings.withColumns(pixels), PIXEL_CELL)


def first_hit(points: DataFrame, rings: DataFrame, order: str = "oid", cell: float = CELL) -> DataFrame:
    """Every point with the object that comes first in `order` of those that hold it; null if none does.

    Each distinct place is tested once and joined back.
    """
    places = points.select("x", "y").distinct().withColumn("pt", F.struct("x", "y"))
    hits = contains(places, rings, cell).groupBy("pt").agg(F.min(order).alias("oid"))
    return points.join(hits.select("pt.x", "pt.y", "oid"), ["x", "y"], "left")


def edge_distance(edges: Column, px: Column, py: Column) -> Column:
    return F.array_min(F.transform(edges, lambda e: measure.segment_distance(px, py, e["x1"], e["y1"], e["x2"], e["y2"])))


def near(points: DataFrame, rings: DataFrame, distance: float, cell: float = CELL) -> DataFrame:
    """pt, oid and distance (plane degrees, 0 inside) of every object within a distance of a point."""
    pairs = candidates(points.select("pt", "x", "y"), shapes(rings), cell, distance)
    x, y = F.col("x"), F.col("y")
    far = F.when(inside(F.col("parts"), x, y), 0.0).otherwise(edge_distance(F.col("close"), x, y))
    return pairs.select("pt", "oid", far.alias("distance")).where(F.col("distance") <= distance)


def outliers(points: DataFrame, rings: DataFrame, cell: float = CELL) -> DataFrame:
    """pt and distance to the nearest object, of the points outside all objects but inside their common box.

    All objects are one range, as the map of a species' distribution is. Each
    distinct place looks for edges as far as a cell's width; the width doubles for
    the places that found none so near.
    """
    box = rings.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()  # one row
    if box[0] is None:
        return points.select("pt", F.lit(0.0).alias("distance")).limit(0)
    shape = shapes(rings)
    edges = shape.select(F.explode(F.flatten("parts")).alias("e")).select("e.*")
    places = points.where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3])).select("x", "y").distinct()
    held = contains(places.withColumn("pt", F.struct("x", "y")), rings, cell).select("pt.x", "pt.y").distinct()
    open_ = settle(places.join(held, ["x", "y"], "left_anti"))
    reach, found = cell, []
    while not open_.isEmpty():
        keyed = open_.withColumn("kx", F.floor(F.col("x") / reach)).withColumn("ky", F.floor(F.col("y") / reach))
        spread = edges.withColumn("kx", F.explode(cells_of(F.least("x1", "x2") - reach, F.greatest("x1", "x2") + reach, reach)))
        spread = spread.withColumn("ky", F.explode(cells_of(F.least("y1", "y2") - reach, F.greatest("y1", "y2") + reach, reach)))
        far = measure.segment_distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
        least = keyed.join(spread, ["kx", "ky"]).groupBy("x", "y").agg(F.min(far).alias("distance")).where(F.col("distance") <= reach)
        now = settle(open_.join(least, ["x", "y"], "left"))
        found.append(now.where("distance is not null"))
        if reach > (box[2] - box[0]) + (box[3] - box[1]):  # no edge at all
            break
        open_, reach = now.where("distance is null").select("x", "y"), reach * 2
    if not found:
        return points.select("pt", F.lit(0.0).alias("distance")).limit(0)
    every = found[0]
    for some in found[1:]:
        every = every.unionByName(some)
    return points.join(every.where("distance > 0"), ["x", "y"]).select("pt", "distance")


def overlapping_boxes(a: DataFrame, b: DataFrame, cell: float = CELL) -> DataFrame:
    """oid_a, oid_b and the common box of objects of two layers whose boxes overlap in an area."""

    def keyed(rings: DataFrame, tag: str) -> DataFrame:
        box = rings.groupBy("oid").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x9"), F.max("y").alias("y9"))
        out = box.select(*(F.col(c).alias(f"{c}_{tag}") for c in box.columns), "x0", "y0", "x9", "y9")
        return out.withColumn("kx", F.explode(cells_of(F.col("x0"), F.col("x9"), cell))).withColumn("ky", F.explode(cells_of(F.col("y0"), F.col("y9"), cell))).drop("x0", "y0", "x9", "y9")

    pairs = keyed(a, "a").join(keyed(b, "b"), ["kx", "ky"]).drop("kx", "ky").distinct()
    low = [F.greatest(f"{c}0_a", f"{c}0_b").alias(f"{c}0") for c in "xy"]
    high = [F.least(f"{c}9_a", f"{c}9_b").alias(f"{c}9") for c in "xy"]
    return pairs.select("oid_a", "oid_b", *low, *high).where("x0 < x9 and y0 < y9")


def within_area(objects: DataFrame, rings: DataFrame) -> DataFrame:
    """The point objects (pid, x, y, ...) inside any object of a layer, each once."""
    hits = contains(objects.withColumn("pt", F.col("pid")), rings).select(F.col("pt").alias("pid")).distinct()
    return objects.join(hits, "pid", "left_semi")


def within_radius(objects: DataFrame, x: float, y: float, metres: float) -> DataFrame:
    """Objects within a distance along the sphere, with it; a latitude band is tested first and reaches the scan."""
    band = metres / measure.EARTH_RADIUS * 57.29577951308232 + 1e-9
    close = objects.where(F.col("y").between(y - band, y + band))
    return close.withColumn("metres", measure.sphere_distance(F.lit(x), F.lit(y), F.col("x"), F.col("y"))).where(F.col("metres") <= metres)


def nearest(objects: DataFrame, x: float, y: float, k: int) -> DataFrame:
    """The k objects of least plane distance, ties by pid, with distance along the sphere and azimuth."""
    dx, dy = F.col("x") - x, F.col("y") - y
    found = objects.withColumn("degrees", F.sqrt(dx * dx + dy * dy)).orderBy("degrees", "pid").limit(k)
    return found.withColumn("metres", measure.sphere_distance(F.lit(x), F.lit(y), F.col("x"), F.col("y"))).withColumn("azimuth", measure.azimuth(F.lit(x), F.lit(y), F.col("x"), F.col("y")))


def within_degrees(rings: DataFrame, x: float, y: float, metres: float) -> DataFrame:
    """oid and distance of the objects within a radius that is turned into plane degrees, at 111 km a degree."""
    place = rings.sparkSession.range(1).select(F.col("id").alias("pt"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    return near(place, rings, metres / 1.11 * 1e-5).select("oid", "distance")


def places_in(places: DataFrame, rings: DataFrame, oid: int | None = None) -> DataFrame:
    """The places (pid, x, y, ...) inside a layer, or inside one object of it."""
    return within_area(places, rings if oid is None else rings.where(F.col("oid") == oid))


def object_contains(rings: DataFrame, oid: int, x: float, y: float) -> DataFrame:
    """One row: whether an object holds a place."""
    place = rings.sparkSession.range(1).select(F.col("id").alias("pt"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    return contains(place, rings.where(F.col("oid") == oid)).agg((F.count("*") > 0).alias("inside"))


def at_location(points: DataFrame, rings: DataFrame, classes: DataFrame, lattice, layer: str) -> DataFrame:
    """pt and pid: the first object that holds a point; where none does, `layer`:class of a class raster; else null."""
    cell = points.select("pt", lattice.key(F.col("x"), F.col("y"), F.col("pt")).alias("cell")).join(classes.select("cell", F.col("value").cast("int").alias("class")), "cell", "left")
    hits = first_hit(points.select("pt", "x", "y"), rings).select("pt", "oid")
    pid = F.coalesce(F.col("oid").cast("string"), F.when(F.col("class").isNotNull(), F.concat_ws(":", F.lit(layer), F.col("class").cast("string"))))
    return hits.join(cell, "pt").select("pt", pid.alias("pid"))


def by_layer_value(objects: DataFrame, cells: DataFrame, lattice, test: Column) -> DataFrame:
    """The point objects whose raster value passes a test of column `value`."""
    placed = objects.withColumn("cell", lattice.cell(F.col("x"), F.col("y")))
    return placed.join(cells.where(test).select("cell").distinct(), "cell", "left_semi").drop("cell")


def numbered_hits(hits: DataFrame) -> DataFrame:
    """All hits of a point with their rank in file order."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("pt").orderBy("oid")))
