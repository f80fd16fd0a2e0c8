"""Geometry as text: WKT, GeoJSON and KML to and from nested arrays, as Column expressions.

An area is an array of polygons, a polygon an array of rings (the first one its
outline), a ring an array of structs (x, y) whose last vertex repeats the first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrafacet.functions import measure

# Patterns of the text forms.
RING = r"\(([^()]*)\)"
POLYGON = r"\(\s*(\([^()]*\)(?:\s*,\s*\([^()]*\))*)\s*\)"
MEMBER = r"([A-Za-z]+\s*(?:\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)|EMPTY))"
MEMBERS = r"MULTIPOLYGON\(%\)|(?:MULTIPOINT|MULTILINESTRING|POLYGON)%|(?:MULTIPOINT|POINT|LINESTRING)@|[A-Z]+ EMPTY"
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:E[-+]?\d+)?"
KINDS = ("POLYGON", "MULTIPOLYGON", "GEOMETRYCOLLECTION")


def _numbers(vertex: Column) -> Column:
    parts = F.split(F.trim(vertex), r"\s+")
    x, y = (F.get(parts, k).try_cast("double") for k in (0, 1))
    return F.struct(x.alias("x"), y.alias("y"))


def _polygons(text: Column) -> Column:
    bodies = F.regexp_extract_all(text, F.lit(POLYGON), F.lit(1))
    return F.transform(bodies, lambda body: F.transform(F.regexp_extract_all(body, F.lit(RING), F.lit(1)), lambda ring: F.transform(F.split(ring, ","), _numbers)))


def geometry_type(wkt: Column) -> Column:
    """The upper-case kind of a WKT text, '' if it begins otherwise."""
    return F.upper(F.regexp_extract(wkt, r"^\s*([A-Za-z]+)", 1))


def from_wkt(wkt: Column) -> Column:
    """The area of a POLYGON, MULTIPOLYGON or GEOMETRYCOLLECTION of such; other kinds have no polygons, null is null."""
    return F.when(geometry_type(wkt).isin(*KINDS), _polygons(wkt)).when(wkt.isNotNull(), F.slice(_polygons(F.lit("((0 0))")), 1, 0))


def valid(area: Column) -> Column:
    """There are polygons, and every ring has four vertices or more, finite ones, and is closed."""

    def sound(ring: Column) -> Column:
        finite = F.forall(ring, lambda v: F.coalesce((F.abs(v["x"]) < float("inf")) & (F.abs(v["y"]) < float("inf")), F.lit(False)))
        return (F.size(ring) >= 4) & finite & (F.get(ring, 0) == F.get(ring, F.size(ring) - 1))

    return F.coalesce((F.size(area) > 0) & F.forall(area, lambda rings: (F.size(rings) > 0) & F.forall(rings, sound)), F.lit(False))


def wkt_form(wkt: Column) -> Column:
    """The whole text follows the grammar of an area, or of a collection of geometries that aren't collections.

    Points, rings, polygons and members are each replaced by a sign, and a list of
    them by one, so that the text shrinks to one of a few forms.
    """
    tight = F.regexp_replace(F.trim(F.regexp_replace(F.upper(wkt), r"\s+", " ")), r" ?([(),]) ?", "$1")
    shrunk = F.regexp_replace(tight, rf"(?<=[(,]){NUMBER} {NUMBER}(?=[,)])", "#")
    for whole, sign in ((r"#", "#"), (r"\(#\)", "@"), (r"\(@\)", "%")):
        shrunk = F.regexp_replace(F.regexp_replace(shrunk, whole, sign), f"(?<={sign}),{sign}", "")
    members = F.regexp_replace(F.regexp_replace(shrunk, rf"(?<=[(,])(?:{MEMBERS})(?=[,)])", "&"), "(?<=&),&", "")
    return ~wkt.rlike("[#@%&]") & (shrunk.isin("POLYGON%", "MULTIPOLYGON(%)") | (members == "GEOMETRYCOLLECTION(&)"))


def wkt_valid(wkt: Column) -> Column:
    """The text is that of an area, as a whole, and its rings are closed. Whether rings cross or nest wrongly is told by `operators.validity`."""
    return F.coalesce(wkt_form(wkt) & valid(from_wkt(wkt)), F.lit(False))


def collection_parts(wkt: Column) -> Column:
    """The member texts of a GEOMETRYCOLLECTION; of another geometry, itself alone."""
    inner = F.regexp_extract(wkt, r"(?is)^\s*GEOMETRYCOLLECTION\s*\((.*)\)\s*$", 1)
    return F.when(geometry_type(wkt) == "GEOMETRYCOLLECTION", F.regexp_extract_all(inner, F.lit(MEMBER), F.lit(1))).otherwise(F.array(F.trim(wkt)))


def _ring_text(ring: Column, between: str, after: str) -> Column:
    return F.array_join(F.transform(ring, lambda v: F.concat_ws(between, v["x"].cast("string"), v["y"].cast("string"))), after)


def to_wkt(area: Column) -> Column:
    """POLYGON for one polygon, else MULTIPOLYGON."""
    texts = F.transform(area, lambda rings: F.concat(F.lit("(("), F.array_join(F.transform(rings, lambda r: _ring_text(r, " ", ",")), "),("), F.lit("))")))
    return F.when(F.size(area) == 1, F.concat(F.lit("POLYGON"), F.get(texts, 0))).otherwise(F.concat(F.lit("MULTIPOLYGON("), F.array_join(texts, ","), F.lit(")")))


def to_geojson(area: Column) -> Column:
    plain = F.transform(area, lambda rings: F.transform(rings, lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"]))))
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get(plain, 0).alias("coordinates")))
    return F.when(F.size(area) == 1, one).otherwise(F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), plain.alias("coordinates"))))


def from_geojson(text: Column) -> Column:
    """The area of a Polygon or MultiPolygon; null if the text is neither or isn't sound."""
    at = F.get_json_object(text, "$.coordinates")
    read = lambda depth: F.from_json(F.concat(F.lit('{"c":'), at, F.lit("}")), "c " + "array<" * depth + "double" + ">" * depth)["c"]
    kind = F.lower(F.get_json_object(text, "$.type"))
    plain = F.when(kind == "polygon", F.array(read(3))).when(kind == "multipolygon", read(4))
    area = F.transform(plain, lambda rings: F.transform(rings, lambda r: F.transform(r, lambda v: F.struct(F.get(v, 0).alias("x"), F.get(v, 1).alias("y")))))
    return F.when(valid(area), area)


def to_kml(area: Column, name: Column) -> Column:
    """A KML placemark with one polygon element a polygon."""

    def ring(tag: str, r: Column) -> Column:
        return F.concat(F.lit(f"<{tag}><LinearRing><coordinates>"), _ring_text(r, ",", " "), F.lit(f"</coordinates></LinearRing></{tag}>"))

    def polygon(rings: Column) -> Column:
        holes = F.transform(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: ring("innerBoundaryIs", r))
        return F.concat(F.lit("<Polygon>"), ring("outerBoundaryIs", F.get(rings, 0)), F.array_join(holes, ""), F.lit("</Polygon>"))

    safe = F.replace(F.replace(F.replace(name, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<Placemark><name>"), safe, F.lit("</name><MultiGeometry>"), F.array_join(F.transform(area, polygon), ""), F.lit("</MultiGeometry></Placemark>"))


def box(area: Column) -> Column:
    """Struct x0, y0, x9, y9: the envelope."""
    outlines = F.flatten(F.transform(area, lambda rings: F.get(rings, 0)))
    ends = [f(F.transform(outlines, lambda v: v[c])).alias(c + n) for f, n in ((F.array_min, "0"), (F.array_max, "9")) for c in "xy"]
    return F.struct(*ends)


def plane_area(area: Column) -> Column:
    """Square degrees: of every polygon its outline without its holes."""
    return _sum(F.transform(area, lambda rings: _outline_less_holes(F.transform(rings, lambda r: F.abs(measure.shoelace(r))))))


def spherical_area(area: Column) -> Column:
    """Square metres on the sphere: of every polygon its outline without its holes."""
    return _sum(F.transform(area, lambda rings: _outline_less_holes(F.transform(rings, measure.spherical_ring_area))))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _outline_less_holes(sizes: Column) -> Column:
    return 2 * F.coalesce(F.get(sizes, 0), F.lit(0.0)) - _sum(sizes)
