"""All spatial queries with their SQL oracles, by name.

A query makes its inputs from fixtures and applies one operator; the oracle says
the same in plain SQL over the same fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafacet.functions import measure
from terrafacet.operators import catalog, facets, legends, polygons, rasters, tabulation
from terrafacet.plans.fixtures import fixture, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LATTICE = rasters.Lattice(112.0, -44.0, 0.5, 0.5, 80, 70)
FOCUS = (132.5, -27.25)


def query(needs: str, sql: str | None = None) -> Callable:
    """Register a query of fixtures, given to it in order, and its oracle over the same names."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        names = needs.split()
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(fixture(spark, sf_dir, n) for n in names))
        if sql is not None:
            ORACLES[f.__name__] = with_clause(*names) + sql if sql.lstrip().startswith("SELECT") else with_clause(*names).rstrip() + ",\n" + sql.lstrip()
        return f

    return register


# Even-odd hits of occurrences in a layer of edges, as common table expressions.
def hits_sql(edge: str, name: str = "hits") -> str:
    return f"""
    {name}_counted AS (
      SELECT pt, oid, part, sum(CASE WHEN (x1 > x) <> (x2 > x) AND (x - x2) * ((y2 - y1) / (x2 - x1)) + y2 > y THEN 1 ELSE 0 END) AS n,
        bool_or(((x1 > x) <> (x2 > x) AND (x - x2) * ((y2 - y1) / (x2 - x1)) + y2 = y) OR (x1 = x AND y1 = y)) AS touches
      FROM occ JOIN {edge} ON true GROUP BY ALL),
    {name} AS (SELECT DISTINCT pt, oid FROM {name}_counted WHERE n % 2 = 1 OR touches)"""


# -- points and polygons ------------------------------------------------------


@query("occ ring edge", hits_sql("edge") + " SELECT pt, oid FROM hits")
def pip_all_hits(occ, ring, _):
    return polygons.contains(occ, ring)


@query("occ ring edge", hits_sql("edge") + " SELECT pt, min(oid) AS oid FROM occ LEFT JOIN hits USING (pt) GROUP BY pt")
def pip_first_hit(occ, ring, _):
    return polygons.first_hit(occ, ring).select("pt", "oid")


@query("occ box box_edge", hits_sql("box_edge") + " SELECT pt, oid FROM hits")
def pip_holes(occ, box, _):
    return polygons.contains(occ, box)


@query(
    "occ ring edge",
    hits_sql("edge")
    + """, far AS (
      SELECT pt, oid, min(sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2))) AS d FROM (
        SELECT *, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t FROM occ JOIN edge ON true)
      GROUP BY pt, oid)
    SELECT pt, oid, round(CASE WHEN h.pt IS NULL THEN d ELSE 0 END, 6) AS distance FROM far LEFT JOIN hits h USING (pt, oid) WHERE h.pt IS NOT NULL OR d <= 0.75""",
)
def pip_near_distance(occ, ring, _):
    return polygons.near(occ, ring, 0.75).withColumn("distance", F.round("distance", 6))


@query(
    "occ ring edge",
    hits_sql("edge")
    + """, box AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x9, max(y) AS y9 FROM ring),
    far AS (
      SELECT pt, min(sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2))) AS d FROM (
        SELECT *, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t FROM occ JOIN edge ON true)
      GROUP BY pt)
    SELECT pt, round(d, 6) AS distance FROM far JOIN occ USING (pt), box
    WHERE pt NOT IN (SELECT pt FROM hits) AND x BETWEEN x0 AND x9 AND y BETWEEN y0 AND y9 AND d > 0""",
)
def outlier_distance(occ, ring, _):
    return polygons.outliers(occ, ring).withColumn("distance", F.round("distance", 6))


@query(
    "ring box",
    """a AS (SELECT oid, min(x) AS x0, min(y) AS y0, max(x) AS x9, max(y) AS y9 FROM ring GROUP BY oid),
    b AS (SELECT oid, min(x) AS x0, min(y) AS y0, max(x) AS x9, max(y) AS y9 FROM box GROUP BY oid)
    SELECT a.oid AS oid_a, b.oid AS oid_b, greatest(a.x0, b.x0) AS x0, greatest(a.y0, b.y0) AS y0, least(a.x9, b.x9) AS x9, least(a.y9, b.y9) AS y9
    FROM a, b WHERE greatest(a.x0, b.x0) < least(a.x9, b.x9) AND greatest(a.y0, b.y0) < least(a.y9, b.y9)""",
)
def polygon_bbox_overlap(ring, box):
    return polygons.overlapping_boxes(ring, box)


@query("object box box_edge", hits_sql("box_edge").replace("FROM occ JOIN", "FROM (SELECT pid AS pt, x, y FROM object) JOIN") + " SELECT pid, name FROM object WHERE pid IN (SELECT pt FROM hits)")
def objects_within_area(objects, box, _):
    return polygons.within_area(objects, box).select("pid", "name")


HAVERSINE = f"2 * asin(sqrt(pow(sin((radians(y) - radians({FOCUS[1]})) / 2), 2) + cos(radians({FOCUS[1]})) * cos(radians(y)) * pow(sin((radians(x) - radians({FOCUS[0]})) / 2), 2))) * 6378137.0"


@query("object", f"SELECT pid, round({HAVERSINE}, 3) AS metres FROM object WHERE {HAVERSINE} <= 500000")
def within_radius(objects):
    return polygons.within_radius(objects, *FOCUS, 500_000).select("pid", F.round("metres", 3).alias("metres"))


@query("object", f"SELECT pid, round({HAVERSINE}, 3) AS metres, round((360 + degrees(atan2(x - {FOCUS[0]}, y - {FOCUS[1]}))) - 360 * floor((360 + degrees(atan2(x - {FOCUS[0]}, y - {FOCUS[1]}))) / 360), 6) AS azimuth FROM object ORDER BY sqrt(pow(x - {FOCUS[0]}, 2) + pow(y - {FOCUS[1]}, 2)), pid LIMIT 10")
def k_nearest(objects):
    return polygons.nearest(objects, *FOCUS, 10).select("pid", F.round("metres", 3).alias("metres"), F.round("azimuth", 6).alias("azimuth"))


# -- rasters ------------------------------------------------------------------

CELL = "CASE WHEN x BETWEEN 112 AND 152 AND y BETWEEN -44 AND -9 THEN (69 - least(69, cast(floor((y + 44) / 0.5) AS int))) * 80 + least(79, cast(floor((x - 112) / 0.5) AS int)) END"


@query("occ raster raster2", f"SELECT pt, layer, value FROM (SELECT pt, layer, c.cell FROM (SELECT pt, {CELL} AS cell FROM occ) c, (VALUES ('el1'), ('el2')) AS l(layer)) LEFT JOIN (SELECT layer, cell, value FROM raster UNION ALL SELECT layer, cell, value FROM raster2) USING (layer, cell)")
def raster_sample(occ, raster, raster2):
    return rasters.sample(occ, raster.unionByName(raster2), LATTICE)


@query("occ raster raster2", f"SELECT pt, a.value AS el1, b.value AS el2 FROM (SELECT pt, {CELL} AS cell FROM occ) LEFT JOIN raster a USING (cell) LEFT JOIN raster2 b USING (cell)")
def multi_field_sample_wide(occ, raster, raster2):
    return rasters.wide(rasters.sample(occ, raster.unionByName(raster2), LATTICE), ["el1", "el2"])


@query("occ classes classname", f"SELECT pt, class, CASE WHEN class IS NOT NULL THEN coalesce(class_name, '') END AS class_name FROM (SELECT pt, cast(value AS int) AS class FROM (SELECT pt, {CELL} AS cell FROM occ) LEFT JOIN classes USING (cell)) LEFT JOIN classname USING (class)")
def raster_class_sample(occ, classes, names):
    return rasters.sample_classes(occ, classes, names, LATTICE)


@query("raster", "SELECT layer, cell, round((cast(value AS double) - low) / (high - low), 9) AS value FROM raster, (SELECT cast(min(value) AS double) AS low, cast(max(value) AS double) AS high FROM raster)")
def raster_standardise(raster):
    return rasters.standardise(raster).withColumn("value", F.round("value", 9))


STANDARD = "SELECT cell, (cast(value AS double) - (SELECT cast(min(value) AS double) FROM {r})) / ((SELECT cast(max(value) AS double) FROM {r}) - (SELECT cast(min(value) AS double) FROM {r})) AS v FROM {r}"


@query("raster raster2", f"SELECT round(avg(abs(a.v - b.v)), 9) AS distance FROM ({STANDARD.format(r='raster')}) a JOIN ({STANDARD.format(r='raster2')}) b USING (cell)")
def layer_distance(raster, raster2):
    return rasters.layer_distance(raster, raster2).select(F.round("distance", 9).alias("distance"))


SOUTH = "abs(-44 + (69 - row) * 0.5 + 0.5)"
AREA = f"radians(0.5) * (sin(radians(floor({SOUTH} / 0.5) * 0.5 + 0.5)) - sin(radians(floor({SOUTH} / 0.5) * 0.5))) * pow(6378.137, 2)"


@query("classes", f"SELECT cast(value AS int) AS class, round(sum({AREA}), 3) AS area, count(*) AS cells, min(row) AS min_row, max(row) AS max_row, min(col) AS min_col, max(col) AS max_col FROM classes GROUP BY 1")
def class_stats(classes):
    return rasters.class_stats(classes, LATTICE).withColumn("area", F.round("area", 3))


RANGES = [(0.0, 150_000.0), (20_000.0, 90_000.0)]
MASK = "SELECT cell, a.row, a.col FROM raster a JOIN raster2 b USING (cell) WHERE a.value BETWEEN 0 AND 150000 AND b.value BETWEEN 20000 AND 90000"


@query("raster raster2", MASK)
def envelope_mask(raster, raster2):
    return rasters.envelope([raster, raster2], RANGES)


@query("raster raster2", f"SELECT round(sum({AREA}), 3) AS area FROM ({MASK})")
def envelope_area(raster, raster2):
    return rasters.envelope([raster, raster2], RANGES).agg(F.round(F.sum(LATTICE.area(F.col("row"))), 3).alias("area"))


@query("raster raster2", f"SELECT min(row) AS top, max(row) AS bottom, min(col) AS \"left\", max(col) AS \"right\", count(*) AS cells FROM ({MASK})")
def cut_extent(raster, raster2):
    return rasters.mask_extent(rasters.envelope([raster, raster2], RANGES))


@query("raster raster2 classes", f"SELECT cell, value FROM classes WHERE cell IN (SELECT cell FROM ({MASK}))")
def raster_cut(raster, raster2, classes):
    return rasters.cut(classes, rasters.envelope([raster, raster2], RANGES)).select("cell", "value")


@query("raster", "SELECT layer, cast(floor(cell / 16) AS bigint) AS run, arg_max(value, cell) AS value FROM raster GROUP BY ALL")
def raster_subsample(raster):
    return rasters.coarsen(raster, 16)


@query("raster classes", "SELECT cell, CASE WHEN b.cell IS NOT NULL THEN a.value END AS value FROM raster a FULL JOIN (SELECT cell FROM classes WHERE value <> 3) b USING (cell)")
def raster_hide_missing(raster, classes):
    return rasters.merge_missing(raster, classes.where("value <> 3"), fill=False)


@query(
    "raster",
    """edges AS (SELECT a.cell AS a, b.cell AS b FROM kept a JOIN kept b ON a.value = b.value AND abs(a.row - b.row) + abs(a.col - b.col) = 1),
    reach(cell, seen) AS (SELECT cell, cell FROM kept UNION SELECT e.a, r.seen FROM reach r JOIN edges e ON e.b = r.cell WHERE r.seen < e.a)
    SELECT k.cell, k.row, k.col, k.value, min(r.seen) AS component FROM kept k JOIN reach r USING (cell) GROUP BY ALL""".replace("edges AS", "kept AS (SELECT cell, row, col, cast(floor(value / 100000) AS int) AS value FROM raster), edges AS", 1),
)
def raster_components(raster):
    return rasters.components(raster.withColumn("value", F.floor(F.col("value") / 100_000).cast("int")))


# -- tabulations --------------------------------------------------------------

BOTH = hits_sql("edge", "a") + "," + hits_sql("box_edge", "b")


@query("occ ring box edge box_edge", BOTH + " SELECT a.oid AS pid1, b.oid AS pid2, count(*) AS occurrences, count(DISTINCT species) AS species FROM occ JOIN a USING (pt) JOIN b USING (pt) GROUP BY ALL")
def tabulate_species(occ, ring, box, *_):
    return tabulation.species_pairs(occ, polygons.contains(occ, ring), polygons.contains(occ, box))


@query(
    "occ ring box edge box_edge",
    BOTH
    + """, m AS (SELECT a.oid AS pid1, b.oid AS pid2, species FROM occ JOIN a USING (pt) JOIN b USING (pt))
    SELECT pid1, pid2, count(*) AS occurrences, count(DISTINCT species) AS species, any_value(t1) AS speciest1, any_value(t2) AS speciest2
    FROM m JOIN (SELECT pid1, count(DISTINCT species) AS t1 FROM m GROUP BY pid1) USING (pid1) JOIN (SELECT pid2, count(DISTINCT species) AS t2 FROM m GROUP BY pid2) USING (pid2) GROUP BY pid1, pid2""",
)
def tabulate_totals(occ, ring, box, *_):
    return tabulation.species_totals(occ, polygons.contains(occ, ring), polygons.contains(occ, box))


@query("raster2 classes", f"SELECT cast(a.value AS int) AS value1, cast(floor(b.value / 20000) AS int) AS value2, round(sum({AREA.replace('row', 'a.row')}), 3) AS area, count(*) AS cells FROM classes a JOIN raster2 b USING (cell) GROUP BY 1, 2")
def tabulate_raster_pair(raster2, classes):
    banded = raster2.withColumn("value", F.floor(F.col("value") / 20_000))
    return tabulation.raster_pair(classes, banded, LATTICE).withColumn("area", F.round("area", 3))


@query("raster raster2 classes", f"SELECT cast(value AS int) AS value, round(sum({AREA}), 3) AS area FROM classes WHERE cell IN (SELECT cell FROM ({MASK})) GROUP BY 1")
def tabulate_raster_region(raster, raster2, classes):
    return tabulation.raster_region(classes, rasters.envelope([raster, raster2], RANGES), LATTICE).withColumn("area", F.round("area", 3))


def tabulated(field: DataFrame) -> DataFrame:
    """A small tabulation of the fields with each other: some rows without an area yet."""
    a, b = field.select(F.col("id").alias("fid1")), field.select(F.col("id").alias("fid2"))
    number = F.expr("cast(substr(fid1, 3) as int) * 7 + cast(substr(fid2, 3) as int) * 3")
    return a.join(b, F.col("fid1") < F.col("fid2")).withColumn("area", F.when(number % 5 != 0, (number % 4).cast("double"))).withColumn("occurrences", F.lit(1))


TABULATED = "tabulated AS (SELECT fid1, fid2, CASE WHEN n % 5 <> 0 THEN cast(n % 4 AS double) END AS area FROM (SELECT a.id AS fid1, b.id AS fid2, cast(substr(a.id, 3) AS int) * 7 + cast(substr(b.id, 3) AS int) * 3 AS n FROM field a JOIN field b ON a.id < b.id))"


@query("field", TABULATED + " SELECT fid1, fid2, area FROM tabulated WHERE area > 0 AND fid1 IN (SELECT id FROM field WHERE enabled) AND fid2 IN (SELECT id FROM field WHERE enabled)")
def list_tabulations(field):
    return tabulation.complete(tabulated(field), field)


@query(
    "field layer",
    TABULATED
    + """, named AS (SELECT f.id, list_transform(string_split(lower(l.domain), ','), lambda d: trim(d)) AS d FROM field f JOIN layer l ON f.spid = cast(l.id AS varchar) WHERE analysis)
    SELECT a.id AS fid1, b.id AS fid2 FROM named a JOIN named b ON a.id < b.id AND (a.d IS NULL OR b.d IS NULL OR list_has_any(a.d, b.d))
    WHERE NOT EXISTS (SELECT 1 FROM tabulated t WHERE t.fid1 = a.id AND t.fid2 = b.id AND area IS NOT NULL)""",
)
def pairs_to_process(field, layer):
    return tabulation.pairs_to_process(field, layer, tabulated(field).where("area is not null").select("fid1", "fid2"))


# -- measures -----------------------------------------------------------------


@query("object", f"SELECT pid, round(x * pi() * 6378137.0 / 180, 3) AS mx, round(ln(tan(radians((y + 90) / 2))) * 6378137.0, 3) AS my, cast(round(268435456.0 + x * (268435456.0 / 180)) AS bigint) AS px FROM object")
def mercator(objects):
    x, y = F.col("x"), F.col("y")
    return objects.select("pid", F.round(measure.mercator_x(x), 3).alias("mx"), F.round(measure.mercator_y(y), 3).alias("my"), measure.pixel_x(x).alias("px"))


@query("object", "SELECT pid, round(x, 9) AS x, round(y, 9) AS y FROM object")
def mercator_round_trip(objects):
    x, y = measure.mercator_x(F.col("x")), measure.mercator_y(F.col("y"))
    return objects.select("pid", F.round(measure.longitude(x), 9).alias("x"), F.round(measure.latitude(y), 9).alias("y"))


@query("object", "SELECT pid, round((360 + degrees(atan2(x - 132.5, y + 27.25))) - 360 * floor((360 + degrees(atan2(x - 132.5, y + 27.25))) / 360), 6) AS azimuth FROM object")
def azimuths(objects):
    return objects.select("pid", F.round(measure.azimuth(F.lit(FOCUS[0]), F.lit(FOCUS[1]), F.col("x"), F.col("y")), 6).alias("azimuth"))


def ring_arrays(rings: DataFrame) -> DataFrame:
    vertices = F.array_sort(F.collect_list(F.struct("i", "x", "y")))
    return rings.groupBy("oid", "ring").agg(F.transform(vertices, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("v"))


@query("ring", "SELECT a.oid, round(sum(a.x * b.y - b.x * a.y) / 2, 6) AS area FROM ring a JOIN ring b ON a.oid = b.oid AND b.i = a.i + 1 GROUP BY a.oid")
def plane_area(ring):
    return ring_arrays(ring).select("oid", F.round(measure.shoelace(F.col("v")), 6).alias("area"))


@query("diamond ring", "SELECT oid, round(cx, 6) AS x, round(cy, 6) AS y FROM diamond")
def ring_centroid(_, ring):
    return ring_arrays(ring).select("oid", F.round(measure.centroid(F.col("v"))["x"], 6).alias("x"), F.round(measure.centroid(F.col("v"))["y"], 6).alias("y"))


def _angle(a: str, b: str) -> str:
    return f"2 * asin(sqrt(pow(sin((radians({b}.y) - radians({a}.y)) / 2), 2) + cos(radians({a}.y)) * cos(radians({b}.y)) * pow(sin((radians({b}.x) - radians({a}.x)) / 2), 2)))"


@query(
    "ring",
    f"""t AS (SELECT a.oid, {_angle('o', 'a')} AS s1, {_angle('a', 'b')} AS s2, {_angle('b', 'o')} AS s3
      FROM ring o JOIN ring a ON a.oid = o.oid AND a.i BETWEEN 1 AND 2 JOIN ring b ON b.oid = a.oid AND b.i = a.i + 1 WHERE o.i = 0)
    SELECT oid, round(sum(4 * atan(sqrt(greatest(0, tan((s1 + s2 + s3) / 4) * tan(((s1 + s2 + s3) / 2 - s1) / 2) * tan(((s1 + s2 + s3) / 2 - s2) / 2) * tan(((s1 + s2 + s3) / 2 - s3) / 2))))) * 6378.137 * 6378.137, 3) AS km2
    FROM t GROUP BY oid""",
)
def spherical_area(ring):
    return ring_arrays(ring).select("oid", F.round(measure.spherical_ring_area(F.col("v")) / 1e6, 3).alias("km2"))


@query("ring", "SELECT oid, min(x) AS x0, min(y) AS y0, max(x) AS x9, max(y) AS y9, count(*) AS vertices FROM ring GROUP BY oid")
def object_extents(ring):
    return ring.groupBy("oid").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x9"), F.max("y").alias("y9"), F.count("*").alias("vertices"))


@query("diamond", "SELECT oid, k, round(degrees(asin(sin(radians(cy)) * cos(100000 / 6378137.0) + cos(radians(cy)) * sin(100000 / 6378137.0) * cos(radians(k * 10)))), 6) AS y FROM diamond, (SELECT unnest(range(0, 36)) AS k)")
def circle_polygon(diamond):
    ring = measure.circle(F.col("cx"), F.col("cy"), F.lit(100_000.0), 36)
    rows = diamond.select("oid", F.posexplode(ring).alias("k", "p")).where("k < 36")
    return rows.select("oid", F.col("k").cast("bigint").alias("k"), F.round("p.y", 6).alias("y"))


@query("diamond", f"SELECT oid, round(radians(0.25) * (sin(radians(floor(abs(cy) / 0.25) * 0.25 + 0.25)) - sin(radians(floor(abs(cy) / 0.25) * 0.25))) * pow(6378.137, 2), 6) AS km2 FROM diamond")
def cell_area(diamond):
    return diamond.select("oid", F.round(measure.cell_area(0.25, F.col("cy")), 6).alias("km2"))


# -- catalogue and search -----------------------------------------------------


@query("field", "SELECT id, name FROM field WHERE id = 'cl6' AND enabled")
def field_by_id(field):
    return field.where("id = 'cl6' and enabled").select("id", "name")


@query("layer field", "SELECT f.id, f.name, l.name AS layer FROM field f JOIN layer l ON f.spid = cast(l.id AS varchar) WHERE l.type = 'Environmental' AND l.enabled AND f.indb")
def fields_of_layers(layer, field):
    usable = layer.where("type = 'Environmental' and enabled").select(F.col("id").cast("string").alias("spid"), F.col("name").alias("layer"))
    return field.where("indb").join(usable, "spid").select("id", "name", "layer")


@query("object", "SELECT pid, name FROM object WHERE contains(lower(name), 'gizmo') OR contains(lower(description), 'gizmo')")
def keyword_search(objects):
    return catalog.keyword_search(objects, ["name", "description"], "GIZMO").select("pid", "name")


@query("object field", "SELECT o.pid, o.name, o.fid, f.name AS field, cast(position('i' IN lower(o.name)) AS int) AS place FROM object o JOIN field f ON f.id = o.fid WHERE f.enabled AND position('i' IN lower(o.name)) > 0 ORDER BY place, o.name, o.pid LIMIT 25 OFFSET 5")
def name_search_ranked(objects, field):
    return catalog.name_search(objects, field, "I", 25, 5)


@query("object field", "SELECT o.pid, o.name, o.fid, f.name AS field, cast(position('w' IN lower(o.name)) AS int) AS place FROM object o JOIN field f ON f.id = o.fid WHERE f.enabled AND f.id IN ('cl2', 'cl5') AND position('w' IN lower(o.name)) > 0 ORDER BY place, o.name, o.pid LIMIT 25")
def name_search_included(objects, field):
    return catalog.name_search(objects, field, "W", 25, include=["cl2", "cl5"], exclude=["cl2"])


@query("field", "SELECT '[' || string_agg('\"' || name || '\"', ',' ORDER BY name) || ']' AS fields FROM (SELECT DISTINCT name FROM field)")
def search_fields_json(field):
    return catalog.field_names_json(field)


@query("object", "SELECT pid, name FROM object ORDER BY pid LIMIT 20 OFFSET 60")
def paged_objects(objects):
    return catalog.page(objects, ["pid"], 3, 20).select("pid", "name")


@query(
    "classes",
    """c AS (SELECT cast(value AS int) AS class, count(*) AS polygons FROM classes GROUP BY 1), e AS (SELECT *, sum(polygons) OVER (ORDER BY class) AS ends FROM c)
    SELECT class, polygons, cast(ends - polygons AS bigint) AS begin FROM e WHERE ends - polygons < 700 AND ends > 500""",
)
def class_pages(classes):
    return catalog.class_pages(classes.groupBy(F.col("value").cast("int").alias("class")).agg(F.count("*").alias("polygons")), 500, 200)


@query(
    "object field",
    """known AS (SELECT cast(row_number() OVER (ORDER BY name) AS int) AS id, lower(name) AS name FROM field),
    new AS (SELECT DISTINCT lower(name) AS name FROM object WHERE lower(name) NOT IN (SELECT name FROM known))
    SELECT id, name FROM known UNION ALL SELECT cast((SELECT max(id) FROM known) + row_number() OVER (ORDER BY name) AS int), name FROM new""",
)
def upsert_names(objects, field):
    known = catalog.upsert_names(field.limit(0).select(F.lit(0).alias("id"), "name"), field)
    return catalog.upsert_names(known, objects)


@query("layer", "SELECT id, CASE WHEN NOT enabled THEN 'disabled' END AS broken FROM layer WHERE NOT enabled")
def quality_checks(layer):
    return catalog.quality_checks(layer)


@query("raster raster2 classes", "SELECT 'el1' AS layer, 1 AS grid_group UNION ALL SELECT 'el2', 1 UNION ALL SELECT 'cl3', 1")
def grid_groups(raster, raster2, classes):
    headers = None
    for cells in (raster, raster2, classes):
        one = cells.select("layer").distinct().select("layer", *(F.lit(v).alias(c) for c, v in (("x", 112.0), ("y", -44.0), ("dx", 0.5), ("dy", 0.5), ("columns", 80), ("rows", 70))))
        headers = one if headers is None else headers.unionByName(one)
    return rasters.same_shape(headers).select("layer", "grid_group")


# -- distributions ------------------------------------------------------------


@query("dist", "SELECT spcode FROM dist WHERE min_depth <= 200 AND max_depth >= 120")
def depth_overlap(dist):
    return catalog.distributions(dist, 120.0, 200.0).select("spcode")


@query("dist", "SELECT spcode FROM dist WHERE max_depth >= 300 AND lower(lsid) IN ('urn:lsid:3', 'urn:lsid:14', 'urn:lsid:25') AND coastal AND pelagic > 0")
def distribution_filter(dist):
    return catalog.distributions(dist, low=300.0, lsids="URN:LSID:3,urn:lsid:14, urn:lsid:25", coastal=True, pelagic=True).select("spcode")


@query("dist", "SELECT spcode FROM dist WHERE lower(lsid) IN ('urn:lsid:1', 'urn:lsid:20')")
def token_membership(dist):
    return dist.where(catalog.token_member("lsid", "urn:lsid:1,URN:LSID:20")).select("spcode")


@query("dist", "SELECT family, count(*) AS count FROM dist WHERE max_depth >= 100 AND pelagic = 0 GROUP BY family")
def family_counts(dist):
    return catalog.family_counts(catalog.distributions(dist, low=100.0, pelagic=False))


@query("dist", """SELECT spcode FROM dist WHERE min_depth <= 400 AND max_depth >= 50 AND family IN ('Brand#11', 'Brand#12', 'Brand#21', 'Brand#33', 'Brand#44') AND genus_lsid <> 'urn:genus:3'
    AND genus IN ('genus 1', 'genus 2', 'genus 3', 'genus 4', 'genus 5', 'genus 6') AND estuarine = false AND desmersal > 0 AND endemic AND type = 'e'""")
def distribution_terms(dist):
    found = catalog.distributions(dist, 50.0, 400.0, families=["Brand#11", "Brand#12", "Brand#21", "Brand#33", "Brand#44"], genera=[f"genus {k}" for k in range(1, 7)], estuarine=False, desmersal=True, endemic=True, kind="e")
    return found.where("genus_lsid != 'urn:genus:3'").select("spcode")


@query("dist", "SELECT spcode FROM dist WHERE family_lsid IN ('urn:family:1', 'urn:family:7', 'urn:family:30', 'urn:family:31') AND genus_lsid IN ('urn:genus:1', 'urn:genus:2', 'urn:genus:8') UNION SELECT spcode FROM dist WHERE group_name = 'group 2' AND geom_idx = 6 UNION SELECT spcode FROM dist WHERE resource = 'PROMO' AND geom_idx = 1")
def distribution_ids(dist):
    first = catalog.distributions(dist, family_lsids=[f"urn:family:{k}" for k in (1, 7, 30, 31)], genus_lsids=[f"urn:genus:{k}" for k in (1, 2, 8)])
    second = catalog.distributions(dist, group="group 2", geometry=6)
    third = catalog.distributions(dist, resources=["PROMO"], geometry=1)
    return first.select("spcode").union(second.select("spcode")).union(third.select("spcode")).distinct()


@query("dist", "SELECT spcode, 'lsid' AS how FROM dist WHERE lsid IN ('urn:lsid:4', 'urn:lsid:9') AND type = 't' UNION ALL SELECT spcode, 'code' FROM dist WHERE spcode = 15 AND type = 'e' UNION ALL SELECT min(spcode), 'number' FROM dist WHERE caab = '37 16' AND type = 'e' UNION ALL SELECT min(spcode), 'name' FROM dist WHERE lower(scientific) = (SELECT lower(scientific) FROM dist WHERE spcode = 20) AND type = 'e'")
def distribution_lookups(dist):
    name = dist.where("spcode = 20").first().scientific
    tagged = lambda df, how: df.select("spcode", F.lit(how).alias("how"))
    found = tagged(catalog.distributions_by_lsid(dist, ["urn:lsid:4", "urn:lsid:9"], "t"), "lsid").union(tagged(catalog.distribution_by_code(dist, 15, "e"), "code"))
    return found.union(tagged(catalog.distribution_by_name(dist, "37 16", "e"), "number")).union(tagged(catalog.distribution_by_name(dist, name.upper(), "e"), "name"))


@query("object", "SELECT pid, name FROM object WHERE fid = 'cl3' AND (lower(name) LIKE '%1%' OR lower(description) LIKE '%1%') ORDER BY pid LIMIT 20 OFFSET 2")
def objects_of_field(objects):
    return catalog.objects_of_field(objects, "cl3", "1", 2, 20).select("pid", "name")


@query("object", "SELECT pid, name FROM object WHERE fid = 'cl4' AND (name ILIKE '%2_' OR lower(name) = (SELECT lower(name) FROM object WHERE pid = '4'))")
def objects_by_name(objects):
    name = objects.where("pid = '4'").first().name
    return catalog.objects_by_name(objects, "cl4", "%2_").union(catalog.objects_by_name(objects, "cl4", name.upper())).select("pid", "name").distinct()


@query("object classes", "SELECT pid, name, fid FROM object WHERE pid = '17' UNION ALL SELECT 'cl3:2', 'class 2', 'cl3'")
def object_by_pid(objects, classes):
    named = classes.select(F.col("layer").alias("fid"), F.col("value").cast("int").alias("class")).distinct().withColumn("class_name", F.concat(F.lit("class "), F.col("class").cast("string")))
    return catalog.object_by_pid(objects, named, "17").union(catalog.object_by_pid(objects, named, "cl3:2"))


@query("object", "SELECT fid, pid, size FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY size DESC, pid) AS r FROM object) WHERE r = 1")
def ordered_distinct(objects):
    """The largest object of every field."""
    rows = objects.select("fid", "pid", "size", (-F.col("size")).alias("less"))
    return catalog.ordered_distinct(rows, ["fid"], ["less", "pid"]).drop("less")


@query("object", "SELECT pid, size, (SELECT count(*) FROM object) AS objects FROM object WHERE size % 5 > 0 OR p_partkey % 3 = 0")
def rows_with_area(objects):
    """Objects without those of no area (a size that five divides), three of whom have no geometry, with the number of all."""
    shaped = objects.withColumn("geometry", F.when(F.col("p_partkey") % 3 != 0, F.col("name"))).withColumn("area", F.col("size") % 5)
    return catalog.with_count(catalog.with_area(shaped), objects, "objects").select("pid", "size", "objects")


# -- facets -------------------------------------------------------------------


def faceted(text: str, where: str) -> Callable:
    return query("occ", f"SELECT pt FROM occ WHERE {where}")(named(text))


def named(text: str) -> Callable:
    def run(occ):
        return occ.where(facets.parse(text).column()).select("pt")

    run.__name__ = FACETS[text][0]
    return run


FACETS = {
    'kind:"click" AND species:[5 TO 20]': ("facet_and", "kind = 'click' AND species BETWEEN 5 AND 20"),
    "kind:view OR year:[2001 TO *]": ("facet_or", "kind = 'view' OR year >= 2001"),
    "-(kind:click OR species:[* TO 10])": ("facet_negated_group", "NOT (kind = 'click' OR species <= 10)"),
    "amount:[10 TO 60.5]": ("facet_range", "amount BETWEEN 10 AND 60.5"),
    "-kind:purchase AND kind:*": ("facet_negated_value", "kind <> 'purchase' AND kind <> ''"),
}
for _text, (_, _where) in FACETS.items():
    faceted(_text, _where)


@query("occ ring edge", hits_sql("edge") + " SELECT count(*) AS count FROM occ WHERE species BETWEEN 3 AND 9 AND pt IN (SELECT pt FROM hits)")
def facet_count(occ, ring, _):
    inside = polygons.contains(occ, ring).select("pt").distinct()
    return occ.where(facets.parse("species:[3 TO 9]").column()).join(inside, "pt", "left_semi").agg(F.count("*").alias("count"))


# -- legends ------------------------------------------------------------------

ENDS = "ends AS (SELECT cast(min(value) AS double) AS low, cast(max(value) AS double) AS high FROM raster), ks AS (SELECT cast(unnest(range(1, 11)) AS int) AS k)"


@query("raster", ENDS + " SELECT k, round(CASE WHEN k = 10 THEN high ELSE low + (high - low) * (k / 10) END, 4) AS cutoff FROM ends, ks")
def legend_even(raster):
    return legends.even(raster, "value").withColumn("cutoff", F.round("cutoff", 4))


@query("raster", ENDS + " SELECT k, round(CASE WHEN k = 10 THEN high ELSE exp(ln(low) + (ln(high) - ln(low)) * (k / 10)) END, 4) AS cutoff FROM ends, ks")
def legend_log(raster):
    return legends.even_log(raster, "value").withColumn("cutoff", F.round("cutoff", 4))


@query("raster", ENDS + " SELECT k, round(CASE WHEN k = 10 THEN high ELSE pow(10, log10(low) + (log10(high) - log10(low)) * (k / 10)) END, 4) AS cutoff FROM ends, ks")
def legend_log10(raster):
    return legends.even_log(raster, "value", True).withColumn("cutoff", F.round("cutoff", 4))


@query("occ", "SELECT cast(floor(year / 10) * 10 AS int) AS low, cast(floor(year / 10) * 10 + 9 AS int) AS high, count(*) AS records FROM occ GROUP BY 1, 2")
def legend_decade(occ):
    return legends.decades(occ, "year")


def equal_area_sql(source: str) -> str:
    """Common table expressions up to g: k, cutoff and n of the classes of equal area of a query's column value."""
    step = "cast(floor(ceil({left} / cast({classes} AS double)) * scale) AS bigint)"
    return f"""h AS (SELECT value, count(*) AS n FROM ({source}) GROUP BY value),
    spread AS (SELECT value, n, cast(sum(n) OVER w - n AS bigint) AS start, cast(sum(n) OVER w AS bigint) AS stop, coalesce(lead(n) OVER w, 0) AS following FROM h WINDOW w AS (ORDER BY value)),
    size AS (SELECT count(*) AS uniques, cast(sum(n) AS bigint) AS everything FROM h),
    up(power, scale) AS (SELECT 0, 1.0::DOUBLE UNION ALL SELECT power + 1, scale * 1.2::DOUBLE FROM up WHERE power < 20),
    down(power, scale) AS (SELECT 0, 1.0::DOUBLE UNION ALL SELECT power - 1, scale / 1.2::DOUBLE FROM down WHERE power > -60),
    walk(power, scale, k, start, latest, alone, cutoff) AS (
      SELECT power, scale, 0, 0::BIGINT, {step.format(left="everything", classes="10")}, {step.format(left="everything", classes="10")}, NULL::DOUBLE
      FROM (SELECT * FROM up UNION SELECT * FROM down), size
      UNION ALL
      SELECT power, scale, k + 1, hit.stop, CASE WHEN k = 9 THEN hit.stop ELSE greatest(hit.stop - 1 + {step.format(left="(everything - hit.stop + 1)", classes="(9 - k)")}, hit.stop) END, alone, hit.value
      FROM (SELECT *, (SELECT min({{'stop': s.stop, 'value': s.value}}) FROM spread s
              WHERE s.start >= walk.start AND (s.stop > least(walk.latest, everything - 1) OR s.n >= walk.alone OR s.following >= walk.alone)) AS hit FROM walk, size WHERE k < 10)
      WHERE hit IS NOT NULL),
    walked AS (SELECT power, max(k) AS classes, max(start) = (SELECT everything FROM size) AS whole FROM walk GROUP BY power),
    chosen AS (
      SELECT CASE WHEN NOT w.whole THEN (SELECT min(power) FROM walked WHERE power > 0 AND whole)
        WHEN w.classes < 10 AND uniques > 10 THEN (SELECT max(power) FROM walked WHERE power < 0 AND classes = 10) ELSE 0 END AS power
      FROM walked w, size WHERE w.power = 0),
    cut AS (SELECT k, cutoff, lag(cutoff) OVER (ORDER BY k) AS low FROM walk JOIN chosen USING (power) WHERE k > 0),
    g AS (SELECT k, cutoff, (SELECT sum(n) FROM h WHERE value <= cut.cutoff AND (cut.low IS NULL OR value > cut.low)) AS n FROM cut)"""


@query(
    "raster",
    """h AS (SELECT cast(value AS double) AS value, count(*) AS n FROM raster WHERE NOT isnan(value) GROUP BY 1),
    ranked AS (SELECT *, row_number() OVER (ORDER BY value) AS rank, count(*) OVER () AS uniques FROM h),
    class(k, seen, rank, cutoff) AS (
      SELECT 0, 0::BIGINT, 0::BIGINT, NULL::DOUBLE
      UNION ALL
      SELECT k + 1, c.seen + step, own.rank + CASE WHEN takes THEN 1 ELSE 0 END, CASE WHEN takes THEN after.value ELSE own.value END
      FROM (SELECT c.*, cast(ceil(((SELECT count(*) FROM h) - seen) / cast(10 - k AS double)) AS bigint) AS step FROM class c WHERE k < 9) c
        JOIN ranked own ON own.rank = c.rank + c.step LEFT JOIN ranked after ON after.rank = own.rank + 1,
        LATERAL (SELECT own.n = 1 AND coalesce(after.n > 1, false) AS takes)
      WHERE c.step > 0 AND (own.rank < own.uniques OR own.n > 1))
    SELECT k, cutoff FROM class WHERE k > 0 UNION ALL SELECT 10, max(value) FROM h HAVING count(*) > 0""",
)
def legend_equal_size(raster):
    return legends.equal_size(raster, "value")


@query("occ", equal_area_sql("SELECT cast(species AS double) AS value FROM occ") + " SELECT k, cutoff FROM g")
def legend_equal_area(occ):
    return legends.equal_area(occ, "species")


@query("raster", ENDS + """, cut AS (SELECT k, CASE WHEN k = 10 THEN high ELSE low + (high - low) * (k / 10) END AS cutoff FROM ends, ks),
    placed AS (SELECT r.value, (SELECT count(*) FROM cut WHERE cutoff < r.value) + 1 AS k FROM (SELECT cast(value AS double) AS value FROM raster) r)
    SELECT k, round(cutoff, 4) AS cutoff, count(value) AS records, count(DISTINCT value) AS uniques FROM cut LEFT JOIN placed USING (k) GROUP BY k, cutoff""")
def legend_sizes(raster):
    return legends.sizes(raster, "value", legends.even(raster, "value")).select("k", F.round("cutoff", 4).alias("cutoff"), "records", "uniques")


@query("raster", ENDS + """, cut AS (
      SELECT 0 AS rank, 'log10' AS name, k, CASE WHEN k = 10 THEN high ELSE pow(10, log10(low) + (log10(high) - log10(low)) * (k / 10)) END AS cutoff FROM ends, ks
      UNION ALL SELECT 1, 'even', k, CASE WHEN k = 10 THEN high ELSE low + (high - low) * (k / 10) END FROM ends, ks
      UNION ALL SELECT 2, 'log', k, CASE WHEN k = 10 THEN high ELSE exp(ln(low) + (ln(high) - ln(low)) * (k / 10)) END FROM ends, ks),
    span AS (SELECT rank, name, k, cutoff, lag(cutoff) OVER (PARTITION BY rank ORDER BY k) AS above FROM cut),
    sized AS (SELECT rank, name, k, count(value) AS n FROM span LEFT JOIN (SELECT cast(value AS double) AS value FROM raster) ON value <= cutoff AND (above IS NULL OR value > above) GROUP BY ALL)
    SELECT name, round(stddev_pop(n), 6) AS deviation FROM sized GROUP BY rank, name ORDER BY stddev_pop(n), rank LIMIT 1""")
def legend_best(raster):
    return legends.best(raster, "value").select("name", F.round("deviation", 6).alias("deviation"))


@query("occ", "SELECT value, records, cast(least(row_number() OVER (ORDER BY records DESC, value), 3) AS int) AS colour FROM (SELECT kind AS value, count(*) AS records FROM occ GROUP BY kind)")
def legend_categories(occ):
    return legends.categories(occ, "kind", 3)


# -- user data ----------------------------------------------------------------


@query("object", "SELECT 'pid' AS field, 'INT' AS type UNION ALL SELECT 'name', 'STRING' UNION ALL SELECT 'x', 'DOUBLE'")
def type_inference(objects):
    found = None
    for column in ("pid", "name", "x"):
        one = catalog.infer_type(objects, column).select(F.lit(column).alias("field"), "type")
        found = one if found is None else found.unionByName(one)
    return found


from terrafacet.plans import areas, cuts, records, stores  # noqa: E402, F401 (they register their queries)
