"""Queries on areas: their text forms, overlay, and searches by place; with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafacet.functions import colours, measure, wkt
from terrafacet.operators import catalog, dissolve, legends, outlines, overlay, polygons, rasters, sampling, simplify, sphere, validity
from terrafacet.plans.catalogue import BOTH, CELL, FOCUS, LATTICE, MASK, RANGES, equal_area_sql, hits_sql, query

# The areas of rings as text, by string aggregation.
RING_TEXT = "rt AS (SELECT oid, part, ring, string_agg(cast(x AS varchar) || ' ' || cast(y AS varchar), ',' ORDER BY i) AS t FROM {0} GROUP BY ALL)"
AREA_TEXT = RING_TEXT + ", wt AS (SELECT oid, 'POLYGON((' || string_agg(t, '),(' ORDER BY ring) || '))' AS wkt FROM rt GROUP BY oid)"


@query("box", AREA_TEXT.format("box") + " SELECT oid, wkt FROM wt")
def wkt_round_trip(box):
    text = overlay.areas_of(box).select("oid", wkt.to_wkt(F.col("geometry")).alias("wkt"))
    return text.select("oid", wkt.to_wkt(wkt.from_wkt(F.col("wkt"))).alias("wkt"))


@query("box", "SELECT oid, part, ring, i, x, y FROM box")
def wkt_to_rings(box):
    text = overlay.areas_of(box).select("oid", wkt.to_wkt(F.col("geometry")).alias("wkt"))
    return overlay.rings_of(text.select("oid", wkt.from_wkt(F.col("wkt")).alias("geometry")))


@query("box", RING_TEXT.format("box").replace("' '", "','").replace("cast(x AS varchar)", "'[' || cast(x AS varchar)").replace("cast(y AS varchar)", "cast(y AS varchar) || ']'") + """ SELECT oid, '{"type":"Polygon","coordinates":[[' || string_agg(t, '],[' ORDER BY ring) || ']]}' AS geojson FROM rt GROUP BY oid""")
def geojson_round_trip(box):
    text = overlay.areas_of(box).select("oid", wkt.to_geojson(F.col("geometry")).alias("geojson"))
    return text.select("oid", wkt.to_geojson(wkt.from_geojson(F.col("geojson"))).alias("geojson"))


@query("diamond ring", RING_TEXT.format("ring").replace("' '", "','").replace("x || ','", "x") .replace("',' ORDER", "' ' ORDER") + " SELECT oid, '<Placemark><name>' || name || '</name><MultiGeometry><Polygon><outerBoundaryIs><LinearRing><coordinates>' || t || '</coordinates></LinearRing></outerBoundaryIs></Polygon></MultiGeometry></Placemark>' AS kml FROM rt JOIN diamond USING (oid)")
def kml_export(diamond, ring):
    return overlay.areas_of(ring).join(diamond.select("oid", "name"), "oid").select("oid", wkt.to_kml(F.col("geometry"), F.col("name")).alias("kml"))


@query("box", "SELECT oid, 240.0e0 AS degrees2, 112 + 8.0e0 * oid AS x0, -44.0e0 AS y0, 120 + 8.0e0 * oid AS x9, -10.0e0 AS y9, 'POLYGON' AS kind, true AS sound FROM (SELECT DISTINCT oid FROM box)".replace("240.0e0", "(8 * 34 - 4 * 18) * 1.0e0"))
def area_measures(box):
    area = overlay.areas_of(box)
    text = wkt.to_wkt(F.col("geometry"))
    return area.select("oid", wkt.plane_area(F.col("geometry")).alias("degrees2"), wkt.box(F.col("geometry")).alias("b"), wkt.geometry_type(text).alias("kind"), wkt.wkt_valid(text).alias("sound")).select("oid", "degrees2", "b.*", "kind", "sound")


@query("ring", AREA_TEXT.format("ring") + " SELECT oid, k, CASE WHEN k = 1 THEN wkt ELSE 'POINT(1 2)' END AS part FROM wt, (VALUES (0), (1)) AS v(k)")
def collection_parts(ring):
    text = overlay.areas_of(ring).select("oid", wkt.to_wkt(F.col("geometry")).alias("wkt"))
    whole = F.concat(F.lit("GEOMETRYCOLLECTION(POINT(1 2),"), F.col("wkt"), F.lit(")"))
    return text.select("oid", F.posexplode(wkt.collection_parts(whole)).alias("k", "part"))


# What diamonds and boxes share, by slabs between the places where the height of a diamond meets a rectangle's ends.
SHARED = """rects AS (
      SELECT oid, h, min(x) AS x0, max(x) AS x9, min(y) AS y0, max(y) AS y9 FROM (SELECT oid, ring AS h, x, y FROM box) GROUP BY oid, h),
    cuts AS (
      SELECT d.oid AS oid_a, r.oid AS oid_b, h, cx, cy, x0, x9, y0, y9, unnest([x0, x9, cx - 5, cx, cx + 5, cx - 5 * (1 - abs(y0 - cy) / 4.375),
        cx + 5 * (1 - abs(y0 - cy) / 4.375), cx - 5 * (1 - abs(y9 - cy) / 4.375), cx + 5 * (1 - abs(y9 - cy) / 4.375)]) AS x
      FROM diamond d JOIN rects r ON x0 < cx + 5 AND x9 > cx - 5 AND y0 < cy + 4.375 AND y9 > cy - 4.375),
    inside AS (SELECT DISTINCT * FROM cuts WHERE x BETWEEN greatest(x0, cx - 5) AND least(x9, cx + 5)),
    slabs AS (SELECT *, lead(x) OVER (PARTITION BY oid_a, oid_b, h ORDER BY x) - x AS w, (lead(x) OVER (PARTITION BY oid_a, oid_b, h ORDER BY x) + x) / 2 AS m FROM inside),
    heights AS (SELECT *, greatest(0, least(y9, cy + 4.375 * (1 - abs(m - cx) / 5)) - greatest(y0, cy - 4.375 * (1 - abs(m - cx) / 5))) AS height FROM slabs WHERE w IS NOT NULL),
    common AS (SELECT oid_a, oid_b, sum(CASE WHEN h = 0 THEN w * height ELSE -w * height END) AS degrees2 FROM heights GROUP BY oid_a, oid_b)"""


@query("diamond ring box", SHARED + " SELECT oid_a, oid_b, round(degrees2, 6) AS degrees2 FROM common WHERE degrees2 > 1e-9")
def overlay_area(_, ring, box):
    return overlay.overlay_areas(ring, box).where("degrees2 > 1e-9").select("oid_a", "oid_b", F.round("degrees2", 6).alias("degrees2"))


# Rings by Euler: of the intervals of all slabs (nodes) and their meetings (links), rings are twice the components, less nodes, plus links.
DISSOLVED = """r AS (SELECT oid, ring AS h, min(x) AS x0, max(x) AS x9, min(y) AS y0, max(y) AS y9 FROM box GROUP BY ALL),
    j AS (SELECT d.oid AS oid_a, o.oid AS oid_b, cx, cy, o.x0, o.x9, o.y0, o.y9, i.x0 AS h0, i.x9 AS h9, i.y0 AS g0, i.y9 AS g9
      FROM diamond d JOIN r o ON o.h = 0 AND o.x0 < cx + 5 AND o.x9 > cx - 5 AND o.y0 < cy + 4.375 AND o.y9 > cy - 4.375 JOIN r i ON i.h = 1 AND i.oid = o.oid),
    cut AS (SELECT DISTINCT j.*, x FROM (SELECT j, unnest([x0, x9, h0, h9, cx - 5, cx, cx + 5] || list_transform([y0, y9, g0, g9], lambda v: cx - 5 * (1 - abs(v - cy) / 4.375)) || list_transform([y0, y9, g0, g9], lambda v: cx + 5 * (1 - abs(v - cy) / 4.375))) AS x FROM j)
      WHERE x BETWEEN greatest(j.x0, j.cx - 5) AND least(j.x9, j.cx + 5)),
    slab AS (SELECT *, x AS a, lead(x) OVER w AS b, row_number() OVER w AS n FROM cut WINDOW w AS (PARTITION BY oid_a, oid_b ORDER BY x)),
    ends AS (SELECT *, (a + b) / 2 AS m, list_transform([a, (a + b) / 2, b], lambda p: greatest(y0, cy - 4.375 * (1 - abs(p - cx) / 5))) AS lo, list_transform([a, (a + b) / 2, b], lambda p: least(y9, cy + 4.375 * (1 - abs(p - cx) / 5))) AS hi FROM slab WHERE b IS NOT NULL),
    node AS (SELECT * FROM (SELECT oid_a, oid_b, n, a, b, k, CASE WHEN k = 2 THEN list_transform(lo, lambda v: greatest(v, g9)) ELSE lo END AS lo, CASE WHEN k = 1 THEN list_transform(hi, lambda v: least(v, g0)) ELSE hi END AS hi
      FROM ends, (VALUES (0), (1), (2)) AS v(k) WHERE (k > 0) = (m > h0 AND m < h9)) WHERE hi[2] > lo[2] + 1e-9),
    link AS (SELECT p.oid_a, p.oid_b, p.n * 3 + p.k AS a, q.n * 3 + q.k AS b FROM node p JOIN node q ON p.oid_a = q.oid_a AND p.oid_b = q.oid_b AND q.n = p.n + 1 AND least(p.hi[3], q.hi[1]) > greatest(p.lo[3], q.lo[1]) + 1e-9),
    ways AS (SELECT * FROM link UNION ALL SELECT oid_a, oid_b, b, a FROM link),
    walked(oid_a, oid_b, a, seen) AS (SELECT oid_a, oid_b, n * 3 + k, n * 3 + k FROM node UNION SELECT w.oid_a, w.oid_b, t.b, w.seen FROM walked w JOIN ways t ON t.oid_a = w.oid_a AND t.oid_b = w.oid_b AND t.a = w.a),
    part AS (SELECT oid_a, oid_b, count(DISTINCT least_) AS c FROM (SELECT oid_a, oid_b, a, min(seen) AS least_ FROM walked GROUP BY ALL) GROUP BY ALL),
    size AS (SELECT oid_a, oid_b, count(*) AS n, sum((b - a) * (hi[2] - lo[2])) AS degrees2 FROM node GROUP BY ALL)
    SELECT oid_a, oid_b, c AS parts, 2 * c - n + (SELECT count(*) FROM link l WHERE l.oid_a = s.oid_a AND l.oid_b = s.oid_b) AS rings, round(degrees2, 6) AS degrees2 FROM size s JOIN part USING (oid_a, oid_b)"""


@query("diamond ring box", DISSOLVED)
def dissolved_overlay(_, ring, box):
    """Parts, rings and size of the outlines of what diamonds and boxes share, by way of their areas."""
    found = dissolve.dissolved_overlay(ring, box).select(F.struct("oid_a", "oid_b").alias("oid"), "part", "ring", "i", "x", "y")
    area = overlay.areas_of(found)
    return area.select("oid.*", F.size("geometry").cast("long").alias("parts"), F.size(F.flatten("geometry")).cast("long").alias("rings"), F.round(wkt.plane_area(F.col("geometry")), 6).alias("degrees2"))


@query("diamond ring box", SHARED + " SELECT oid_a AS oid, round(degrees2, 6) AS degrees2 FROM common WHERE oid_b = 2 AND degrees2 > 1e-9")
def layer_in_area(_, ring, box):
    return overlay.layer_in_area(ring, box.where("oid = 2")).where("degrees2 > 1e-9").select("oid", F.round("degrees2", 6).alias("degrees2"))


@query("diamond ring box", SHARED + " SELECT DISTINCT oid_a AS oid FROM common WHERE oid_b IN (1, 3) AND degrees2 > 1e-9")
def objects_intersecting(_, ring, box):
    return overlay.objects_intersecting(ring, box.where("oid in (1, 3)"))


@query("dist diamond ring box", SHARED + " SELECT spcode, geom_idx, round(degrees2, 6) AS degrees2 FROM dist JOIN common ON oid_a = geom_idx WHERE oid_b = 3 AND degrees2 > 1e-9 AND type = 't' AND max_depth >= 300")
def distributions_in_area(dist, _, ring, box):
    found = overlay.distributions_in(catalog.distributions(dist, low=300.0, kind="t"), ring, box.where("oid = 3"))
    return found.where("degrees2 > 1e-9").select("spcode", "geom_idx", F.round("degrees2", 6).alias("degrees2"))


AWAY = "sqrt(pow(v.x - (p.x + t * (q.x - p.x)), 2) + pow(v.y - (p.y + t * (q.y - p.y)), 2))"


@query("coast", f"""span(oid, a, b) AS (SELECT oid, min(i), max(i) FROM coast GROUP BY oid UNION ALL
      SELECT oid, unnest([a, k]), unnest([k, b]) FROM (SELECT oid, a, b, -(m.less) AS k FROM (SELECT v.oid, a, b, max({{'d': {AWAY}, 'less': -v.i}}) AS m
        FROM (SELECT s.oid, s.a, s.b, v.i, v.x, v.y, CASE WHEN p.x = q.x AND p.y = q.y THEN 0 ELSE greatest(0, least(1, ((v.x - p.x) * (q.x - p.x) + (v.y - p.y) * (q.y - p.y)) / (pow(q.x - p.x, 2) + pow(q.y - p.y, 2)))) END AS t
          FROM span s JOIN coast p ON p.oid = s.oid AND p.i = s.a JOIN coast q ON q.oid = s.oid AND q.i = s.b JOIN coast v ON v.oid = s.oid AND v.i > s.a AND v.i < s.b) AS v
        JOIN coast p ON p.oid = v.oid AND p.i = v.a JOIN coast q ON q.oid = v.oid AND q.i = v.b GROUP BY ALL) WHERE m.d > 1.5)),
    kept AS (SELECT oid, a AS i FROM span UNION SELECT oid, b FROM span)
    SELECT oid, cast(row_number() OVER (PARTITION BY oid ORDER BY i) - 1 AS int) AS i, x, y FROM kept JOIN coast USING (oid, i)""")
def simplified_outlines(coast):
    return simplify.renumbered(simplify.simplified(coast, 1.5)).select("oid", "i", "x", "y")


# What is done to the text of a box with a hole, and whether it is an area then.
SPOILT = [
    ("wkt", True),
    ("concat(wkt, ' or so')", False),
    ("concat('POLYGON((', hole, '),(', outline, '))')", False),  # the hole around its outline
    ("concat('MULTIPOLYGON(((', outline, ')),((', hole, ')))')", False),  # parts on each other
    ("concat('MULTIPOLYGON(((', outline, '),(', hole, ')),((', hole, ')))')", False),  # a part that fills a hole shares its border
    ("concat('MULTIPOLYGON(((', outline, '),(', hole, ')),((0 0,1 0,1 1,0 1,0 0)))')", True),
    ("concat('GEOMETRYCOLLECTION(POINT(1 2),', wkt, ')')", True),
    ("concat('POLYGON((', outline, '),(0 0,1 0,1 1,0 1,0 0))')", False),  # a hole outside
    ("replace(concat('POLYGON((', outline, '))'), '(112.0 -44.0,', '(112.0 -44.0,160.0 -20.0,')", None),
    ("concat('POLYGON((', outline, '),(', hole, '),(', hole, '))')", False),
]


@query("box", "o AS (SELECT DISTINCT oid FROM box) SELECT oid, k, CASE WHEN k = 8 THEN oid <> 0 ELSE sound END AS valid FROM o, (VALUES " + ", ".join(f"({k}, {v is not False})" for k, (_, v) in enumerate(SPOILT)) + ") AS v(k, sound)")
def area_validity(box):
    """Texts of areas that are valid or spoilt in one of several ways; in one of them the first box's outline crosses itself."""
    text = overlay.areas_of(box).select("oid", wkt.to_wkt(F.col("geometry")).alias("wkt"))
    ring = [F.regexp_extract(F.regexp_extract(F.col("wkt"), r"\(\((.*)\)\)", 1), p, 1) for p in (r"^(.*)\),\(", r"\),\((.*)$")]
    text = text.select("oid", "wkt", ring[0].alias("outline"), ring[1].alias("hole"))
    every = text.select("oid", F.posexplode(F.array(*(F.expr(e) for e, _ in SPOILT))).alias("k", "wkt")).select(F.struct("oid", "k").alias("oid"), "wkt")
    return validity.valid_areas(every).select("oid.oid", "oid.k", "valid")


PLOTS = "p AS (SELECT oid, min(x) AS x0, min(y) AS y0, max(x) AS x9, max(y) AS y9 FROM plot GROUP BY oid)"


@query("plot", PLOTS + " SELECT a.oid AS oid_a, b.oid AS oid_b FROM p a JOIN p b ON a.oid < b.oid AND a.x0 <= b.x9 AND b.x0 <= a.x9 AND a.y0 <= b.y9 AND b.y0 <= a.y9")
def objects_touching(plot):
    """Plots that share a side or a corner."""
    return overlay.relations(plot, plot).where("oid_a < oid_b").select("oid_a", "oid_b")


@query("plot diamond ring", PLOTS + """ SELECT d.oid AS oid_a, p.oid AS oid_b, x0 <= cx - 5 AND x9 >= cx + 5 AND y0 <= cy - 4.375 AND y9 >= cy + 4.375 AS within FROM diamond d JOIN p
    ON abs(greatest(x0, least(x9, cx)) - cx) / 5 + abs(greatest(y0, least(y9, cy)) - cy) / 4.375 <= 1""")
def object_relations(plot, _, ring):
    return overlay.relations(ring, plot).select("oid_a", "oid_b", "within")


@query("plot box", PLOTS + """, r AS (SELECT ring AS h, oid AS b, min(x) AS x0, min(y) AS y0, max(x) AS x9, max(y) AS y9 FROM box GROUP BY ALL)
    SELECT DISTINCT p.oid FROM p JOIN r o ON o.h = 0 AND p.x0 >= o.x0 AND p.x9 <= o.x9 AND p.y0 >= o.y0 AND p.y9 <= o.y9
    JOIN r h ON h.h = 1 AND h.b = o.b AND NOT (p.x0 < h.x9 AND p.x9 > h.x0 AND p.y0 < h.y9 AND p.y9 > h.y0)""")
def objects_within(plot, box):
    """Plots within a box and clear of its hole."""
    return overlay.objects_within(plot, box)


@query(
    "occ diamond ring box edge box_edge",
    BOTH
    + """, clip AS (SELECT pt FROM b WHERE oid = 2), """
    + SHARED
    + """, met AS (SELECT x.oid AS pid1, y.oid AS pid2, count(*) AS occurrences, count(DISTINCT species) AS species
      FROM occ JOIN clip USING (pt) JOIN a x USING (pt) JOIN b y USING (pt) GROUP BY ALL)
    SELECT oid_a AS pid1, oid_b AS pid2, round(degrees2, 6) AS degrees2, coalesce(occurrences, 0) AS occurrences, coalesce(species, 0) AS species
    FROM common LEFT JOIN met ON oid_a = pid1 AND oid_b = pid2 WHERE oid_b = 2 AND degrees2 > 1e-9""",
)
def clipped_tabulation(occ, _, ring, box, *__):
    found = overlay.clipped_tabulation(occ, ring, box, box.where("oid = 2"))
    return found.where("degrees2 > 1e-9").select("pid1", "pid2", F.round("degrees2", 6).alias("degrees2"), "occurrences", "species")


# -- searches by place


@query("ring edge", f"""far AS (SELECT oid, min(sqrt(pow({FOCUS[0]} - (x1 + t * (x2 - x1)), 2) + pow({FOCUS[1]} - (y1 + t * (y2 - y1)), 2))) AS d FROM (
        SELECT *, greatest(0, least(1, (({FOCUS[0]} - x1) * (x2 - x1) + ({FOCUS[1]} - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t FROM edge) GROUP BY oid),
    hit AS (SELECT oid FROM (SELECT oid, sum(CASE WHEN (x1 > {FOCUS[0]}) <> (x2 > {FOCUS[0]}) AND ({FOCUS[0]} - x2) * ((y2 - y1) / (x2 - x1)) + y2 > {FOCUS[1]} THEN 1 ELSE 0 END) AS n FROM edge GROUP BY oid) WHERE n % 2 = 1)
    SELECT oid, round(CASE WHEN h.oid IS NULL THEN d ELSE 0 END, 6) AS distance FROM far LEFT JOIN hit h USING (oid) WHERE h.oid IS NOT NULL OR d <= 600000 / 1.11 * 1e-5""")
def within_degrees(ring, _):
    return polygons.within_degrees(ring, *FOCUS, 600_000).select("oid", F.round("distance", 6).alias("distance"))


HAVERSINE = "2 * asin(sqrt(least(1, pow(sin((radians(b.y) - radians(a.y)) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin((radians(b.x) - radians(a.x)) / 2), 2)))) * 6378137.0"


@query("globe", f"d AS (SELECT a.pid AS pt, b.pid AS pid, {HAVERSINE} AS m FROM globe a JOIN globe b ON a.pid % 4 = 0) SELECT pt, pid, round(m, 2) AS metres FROM d WHERE m <= 1500000")
def radius_join(globe):
    """Places over the whole sphere, poles and date line included."""
    places = globe.where("pid % 4 = 0").select(F.col("pid").alias("pt"), "x", "y")
    return sphere.within_radius(places, globe, 1_500_000, digits=2)


IN_BOX = hits_sql("box_edge").replace("FROM occ JOIN", "FROM (SELECT pid AS pt, x, y FROM object) JOIN")


@query("object box box_edge", IN_BOX + " SELECT count(*) AS count FROM (SELECT DISTINCT pt FROM hits WHERE oid = 3)")
def places_in_object_count(objects, box, _):
    return polygons.places_in(objects, box, 3).agg(F.count("*").alias("count"))


@query("ring edge", f"SELECT count(*) > 0 AS inside FROM (SELECT sum(CASE WHEN (x1 > {FOCUS[0]}) <> (x2 > {FOCUS[0]}) AND ({FOCUS[0]} - x2) * ((y2 - y1) / (x2 - x1)) + y2 > {FOCUS[1]} THEN 1 ELSE 0 END) AS n FROM edge WHERE oid = 12) WHERE n % 2 = 1")
def object_contains(ring, _):
    return polygons.object_contains(ring, 12, *FOCUS)


@query("occ ring edge classes", hits_sql("edge") + f", c AS (SELECT pt, {CELL} AS cell FROM occ) SELECT c.pt, coalesce(cast(min(h.oid) AS varchar), 'cl3:' || cast(any_value(cast(k.value AS int)) AS varchar)) AS pid FROM c LEFT JOIN hits h USING (pt) LEFT JOIN classes k USING (cell) GROUP BY c.pt")
def pids_at_location(occ, ring, _, classes):
    return polygons.at_location(occ, ring, classes, LATTICE, "cl3")


@query("object raster", f"SELECT pid FROM (SELECT pid, {CELL} AS cell FROM object) JOIN raster USING (cell) WHERE value BETWEEN 50000 AND 150000")
def objects_by_layer_value(objects, raster):
    return polygons.by_layer_value(objects, raster, LATTICE, F.col("value").between(50_000, 150_000)).select("pid")


# -- rasters


@query("raster raster2", "SELECT layer, min(value) AS low, max(value) AS high FROM (SELECT layer, value FROM raster UNION ALL SELECT layer, value FROM raster2) GROUP BY layer")
def raster_minmax(raster, raster2):
    return rasters.minmax(raster.unionByName(raster2))


@query("classes", "SELECT layer, cell, cast(CASE value WHEN 3 THEN 30 WHEN 5 THEN 2 ELSE value END AS float) AS value FROM classes")
def raster_translate(classes):
    values = classes.sparkSession.createDataFrame([(3, 30), (5, 2)], "old int, new int")
    return rasters.translate(classes, values)


@query("diamond", "SELECT oid, ceil((cx - 0.3) / 0.25) * 0.25 AS low, greatest(floor((cx + 0.4) / 0.25) * 0.25, ceil((cx - 0.3) / 0.25) * 0.25 + 0.5) AS high FROM diamond")
def snapped_extents(diamond):
    low, high = rasters.snap_extent(F.col("cx") - 0.3, F.col("cx") + 0.4, 0.25)
    return diamond.select("oid", low.alias("low"), high.alias("high"))


@query("ring box", "SELECT max(x0) AS x0, max(y0) AS y0, min(x9) AS x9, min(y9) AS y9 FROM (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x9, max(y) AS y9 FROM ring UNION ALL SELECT min(x), min(y), max(x), max(y) FROM box)")
def common_extent(ring, box):
    one = lambda r: r.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x9"), F.max("y").alias("y9"))
    return rasters.common_extent(one(ring).unionByName(one(box)))


@query("field", "SELECT id AS layer, min(r) AS resolution FROM (SELECT id, r FROM field, (VALUES (0.0025e0), (0.01e0), (0.5e0)) AS v(r) WHERE cast(substr(id, 3) AS int) % 3 <> 1 OR r > 0.01) WHERE r >= 0.005 GROUP BY id")
def resolution_fallback(field):
    held = field.select(F.col("id").alias("layer"), F.explode(F.array(*map(F.lit, (0.0025, 0.01, 0.5)))).alias("resolution"))
    return rasters.resolution_of(held.where("cast(substr(layer, 3) as int) % 3 <> 1 or resolution > 0.01"), 0.005)


@query("occ", f"SELECT row, records, cast(sum(records) OVER (ORDER BY row) - records AS bigint) AS start FROM (SELECT cast(floor(c / 80) AS int) AS row, count(*) AS records FROM (SELECT {CELL} AS c FROM occ) WHERE c IS NOT NULL GROUP BY 1)")
def record_row_starts(occ):
    return rasters.row_starts(occ, LATTICE)


@query("object", "SELECT cast(p_partkey AS int) AS class, name AS class_name, cast(min(p_partkey) OVER (PARTITION BY name) AS int) AS merged FROM object")
def merged_classes(objects):
    return rasters.merge_classes(objects.select(F.col("p_partkey").cast("int").alias("class"), F.col("name").alias("class_name")))


# Components by reachability; rings and corners by how many of a component's cells meet at a lattice point: a ring turns by four
# corners to the left, a hole by four to the right.
OUTLINED = """edges AS (SELECT a.cell AS a, b.cell AS b FROM kept a JOIN kept b ON a.value = b.value AND abs(a.row - b.row) + abs(a.col - b.col) = 1),
    reach(cell, seen) AS (SELECT cell, cell FROM kept UNION SELECT e.a, r.seen FROM reach r JOIN edges e ON e.b = r.cell WHERE r.seen < e.a),
    comp AS (SELECT k.cell, k.row, k.col, min(r.seen) AS component FROM kept k JOIN reach r USING (cell) GROUP BY ALL),
    meet AS (SELECT component, x, y, count(*) AS n, count(*) = 2 AND sum(a) = 1 AND sum(b) = 1 AS crosswise
      FROM (SELECT component, col + a AS x, row + b AS y, a, b FROM comp, (VALUES (0), (1)) AS u(a), (VALUES (0), (1)) AS v(b)) GROUP BY ALL),
    turns AS (SELECT component, count(CASE WHEN n = 1 THEN 1 END) AS l, count(CASE WHEN n = 3 THEN 1 END) + 2 * count(CASE WHEN crosswise THEN 1 END) AS r FROM meet GROUP BY component)
    SELECT component, cast(2 - (l - r) // 4 AS bigint) AS rings, cast(l + r AS bigint) AS corners, count(*) * 0.25e0 AS degrees2
    FROM turns JOIN comp USING (component) GROUP BY component, l, r"""


def outlined(cells):
    """Rings, corners and size of the polygons of each component, by way of their text."""
    text = overlay.areas_of(outlines.outlines(rasters.components(cells), LATTICE)).select("oid", wkt.to_wkt(F.col("geometry")).alias("wkt"))
    area = text.select("oid", wkt.from_wkt(F.col("wkt")).alias("g"))
    rings = F.flatten("g")
    corners = F.aggregate(rings, F.lit(0).cast("long"), lambda n, r: n + F.size(r) - 1)
    return area.select(F.col("oid").alias("component"), F.size(rings).cast("long").alias("rings"), corners.alias("corners"), wkt.plane_area(F.col("g")).alias("degrees2"))


@query("raster", "kept AS (SELECT cell, row, col, cast(floor(value / 100000) AS int) AS value FROM raster), " + OUTLINED)
def raster_outlines(raster):
    return outlined(raster.withColumn("value", F.floor(F.col("value") / 100_000).cast("int")))


@query("raster raster2", f"kept AS (SELECT cell, row, col, 1 AS value FROM ({MASK})), " + OUTLINED)
def envelope_outlines(raster, raster2):
    return outlined(rasters.envelope([raster, raster2], RANGES).withColumn("value", F.lit(1)))


LATTICE_SQL = "lat AS (SELECT cast(c AS int) AS c, cast(u AS int) AS u, 112 + c * 0.5e0 AS c0, -44 + u * 0.5e0 AS r0 FROM range(80) AS a(c), range(70) AS b(u))"
SIDE = "(x2 - x1) * (r0 + {b} - y1) - (y2 - y1) * (c0 + {a} - x1)"
SIDES = ", ".join(SIDE.format(a=a, b=b) for a in ("0", "0.5e0") for b in ("0", "0.5e0"))


def states_sql(edge: str) -> str:
    centre = hits_sql(edge).replace("FROM occ JOIN", "FROM (SELECT (69 - u) * 80 + c AS pt, c0 + 0.25e0 AS x, r0 + 0.25e0 AS y FROM lat) JOIN")
    return f"""{LATTICE_SQL}, {centre},
    partial AS (SELECT DISTINCT oid, (69 - u) * 80 + c AS cell FROM lat JOIN {edge} ON greatest(x1, x2) > c0 AND least(x1, x2) < c0 + 0.5e0
      AND greatest(y1, y2) > r0 AND least(y1, y2) < r0 + 0.5e0 AND greatest({SIDES}) > 0 AND least({SIDES}) < 0),
    states AS (SELECT oid, cell, 'partial' AS state FROM partial UNION ALL SELECT oid, pt, 'full' FROM hits WHERE (oid, pt) NOT IN (SELECT (oid, cell) FROM partial))
    SELECT oid, cast(cell AS bigint) AS cell, cast(floor(cell / 80) AS int) AS row, cell % 80 AS col, state FROM states"""


@query("ring edge", states_sql("edge"))
def cell_states(ring, _):
    return rasters.cell_states(ring, LATTICE)


@query("box box_edge", states_sql("box_edge"))
def cell_states_holes(box, _):
    return rasters.cell_states(box, LATTICE)


# -- colours

PLACE = "(value - low) / (high - low) * 10"
CHANNEL = "cast(floor((({{c}}[least(floor({p}), 9)::int + 1] >> {s}) & 255) * (1 - ({p} - least(floor({p}), 9))) + (({{c}}[least(floor({p}), 9)::int + 2] >> {s}) & 255) * ({p} - least(floor({p}), 9))) AS int)"


def _channel(shift: int) -> str:
    return CHANNEL.format(p=PLACE, s=shift).replace("{c}", str(colours.RAMP))


@query("raster", f"v AS (SELECT cell, cast(value AS double) AS value, (SELECT cast(min(value) AS double) FROM raster) AS low, (SELECT cast(max(value) AS double) FROM raster) AS high FROM raster) SELECT cell, cast({_channel(16)} AS varchar) || ',' || cast({_channel(8)} AS varchar) || ',' || cast({_channel(0)} AS varchar) AS rgb FROM v")
def colour_ramp(raster):
    ends = raster.agg(F.min("value").cast("double").alias("low"), F.max("value").cast("double").alias("high"))
    colour = colours.ramp(F.col("value").cast("double"), F.col("low"), F.col("high"))
    return raster.crossJoin(F.broadcast(ends)).select("cell", colours.rgb_text(colour).alias("rgb"))  # one row


EQUAL_AREA = equal_area_sql("SELECT cast(species AS double) AS value FROM occ WHERE species <> 5") + """,
    o AS (SELECT row_number() OVER (ORDER BY cutoff) AS k, n, lag(cutoff) OVER (ORDER BY cutoff) AS low, cutoff, lead(cutoff) OVER (ORDER BY cutoff) AS more FROM g)"""


@query("occ", EQUAL_AREA + """ SELECT cast(k AS int) AS colour, 'species:[' || coalesce(cast(low AS varchar), '*') || ' TO ' || CASE WHEN more IS NULL THEN '*' ELSE cast(cutoff AS varchar) END || ']' AS name, cast(n AS bigint) AS records FROM o
    UNION ALL SELECT 0, 'n/a', count(*) FROM occ WHERE species = 5""")
def legend_of_numbers(occ):
    return legends.by_type(occ.withColumn("species", F.when(F.col("species") != 5, F.col("species"))), "species")


@query("occ", """c AS (SELECT species, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, 's' || species) AS r FROM occ GROUP BY species)
    SELECT cast(r AS int) AS colour, 's' || species AS name, n AS records FROM c WHERE r < 10
    UNION ALL SELECT 10, count(*) || ' more', cast(sum(n) AS bigint) FROM c WHERE r >= 10""")
def legend_of_texts(occ):
    return legends.by_type(occ.withColumn("species", F.concat(F.lit("s"), F.col("species").cast("string"))), "species")


# -- pixels, rings and samples

PIXEL_Y = "round(268435456e0 - 268435456e0 / pi() * ln((1 + sin(radians({y}))) / (1 - sin(radians({y})))) / 2)"
PIXEL_X = "round(268435456e0 + {x} * (268435456e0 / 180))"


@query("object", f"p AS (SELECT pid, {PIXEL_X.format(x='x')} - {PIXEL_X.format(x='132.5e0')} AS a, {PIXEL_Y.format(y='y')} - {PIXEL_Y.format(y='(-27.25e0)')} AS b FROM object) SELECT pid, cast(floor(sqrt(a * a + b * b)) AS bigint) >> 13 AS pixels FROM p")
def pixel_distances(objects):
    x, y = (F.lit(v) for v in FOCUS)
    return objects.select("pid", measure.pixel_distance(F.col("x"), F.col("y"), x, y, 8).alias("pixels"))


@query("occ edge ring", f"pocc AS (SELECT pt, {PIXEL_X.format(x='x')} AS x, {PIXEL_Y.format(y='y')} AS y FROM occ), pedge AS (SELECT oid, part, {PIXEL_X.format(x='x1')} AS x1, {PIXEL_Y.format(y='y1')} AS y1, {PIXEL_X.format(x='x2')} AS x2, {PIXEL_Y.format(y='y2')} AS y2 FROM edge), " + hits_sql("pedge").replace("FROM occ JOIN", "FROM pocc JOIN") + " SELECT pt, oid FROM hits")
def pip_pixels(occ, _, ring):
    return polygons.contains_in_pixels(occ, ring)


@query("ring", "SELECT oid, i, greatest(-180, least(180, x * 1.2e0)) AS x, greatest(-90, least(90, y * 3)) AS y FROM ring")
def clamped_rings(ring):
    v = F.transform(F.array_sort(F.collect_list(F.struct("i", "x", "y"))), lambda p: F.struct((p["x"] * 1.2).alias("x"), (p["y"] * 3).alias("y")))
    open_ = ring.where("i < 4").groupBy("oid").agg(v.alias("v"))
    return open_.select("oid", F.posexplode(measure.clamped_ring(F.col("v"))).alias("i", "p")).select("oid", "i", "p.x", "p.y")


@query("box box_edge", LATTICE_SQL + "," + hits_sql("box_edge").replace("FROM occ JOIN", "FROM (SELECT (69 - u) * 80 + c AS pt, c0 + 0.25e0 AS x, r0 + 0.25e0 AS y FROM lat) JOIN") + " SELECT cast(pt AS bigint) AS cell, cast(floor(pt / 80) AS int) AS row, pt % 80 AS col, min(oid) AS oid FROM hits GROUP BY pt")
def rasterised(box, _):
    return rasters.rasterise(box, LATTICE)


@query("ring edge", LATTICE_SQL + "," + hits_sql("edge").replace("FROM occ JOIN", "FROM (SELECT (69 - u) * 80 + c AS pt, c0 + 0.25e0 AS x, r0 + 0.25e0 AS y FROM lat) JOIN") + " SELECT DISTINCT cast(pt AS bigint) AS cell, cast(floor(pt / 80) AS int) AS row, pt % 80 AS col FROM hits")
def region_mask(ring, _):
    return rasters.region_mask(ring, LATTICE)


@query("raster", "SELECT layer, cast(floor(row / 4) AS int) AS row, cast(floor(col / 4) AS int) AS col, round(avg(cast(value AS double)), 4) AS value FROM raster GROUP BY ALL")
def raster_resampled(raster):
    return rasters.resample(raster, 4).withColumn("value", F.round("value", 4))


@query("occ ring edge diamond raster classes classname", hits_sql("edge") + f""", c AS (SELECT pt, {CELL} AS cell FROM occ), h AS (SELECT pt, min(oid) AS oid FROM hits GROUP BY pt)
    SELECT pt, 'cl9' AS field, 'Diamonds' AS layername, coalesce(name, '') AS value, cast(oid AS varchar) AS pid, CAST(NULL AS varchar) AS units FROM occ LEFT JOIN h USING (pt) LEFT JOIN diamond USING (oid)
    UNION ALL SELECT pt, 'el1', 'Elevation', coalesce(cast(floor(value) AS varchar), ''), NULL, 'm' FROM c LEFT JOIN raster USING (cell)
    UNION ALL SELECT pt, 'cl3', 'Cover', coalesce(class_name, ''), CASE WHEN class_name IS NOT NULL THEN '77:' || class END, NULL FROM c LEFT JOIN (SELECT cell, cast(value AS int) AS class FROM classes) USING (cell) LEFT JOIN classname USING (class)""")
def rich_samples(occ, ring, _, diamond, raster, classes, names):
    found = sampling.of_polygons(occ, ring, diamond, "cl9", "Diamonds")
    found = found.unionByName(sampling.of_raster(occ, raster.withColumn("value", F.floor("value").cast("float")), LATTICE, "el1", "Elevation", "m"))
    return found.unionByName(sampling.of_classes(occ, classes, names, LATTICE, "cl3", "Cover", "77"))
