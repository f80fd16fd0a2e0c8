"""Queries that cut layers of several lattices or cache them for lookups, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafacet.operators import cutting, resampling
from terrafacet.operators.rasters import Lattice
from terrafacet.plans.catalogue import LATTICE, query
from terrafacet.session import working_folder
from terrafacet.sources import grid_cache

WIDE = Lattice(110.0, -46.0, 0.75, 0.75, 80, 70)
FINE = Lattice(120.0, -40.0, 0.25, 0.25, 80, 70)


def layers_of(raster, raster2, classes):
    return [cutting.Layer(raster, LATTICE), cutting.Layer(raster2, WIDE), cutting.Layer(classes, FINE)]


# The layers with their lattices, and the place that a cell of an even lattice asks for.
LAYERS = """src AS (
      SELECT layer, row, col, value, 112.0e0 AS x0, -44.0e0 AS y0, 0.5e0 AS d FROM raster
      UNION ALL SELECT layer, row, col, value, 110.0e0, -46.0e0, 0.75e0 FROM raster2
      UNION ALL SELECT layer, row, col, value, 120.0e0, -40.0e0, 0.25e0 FROM classes),
    frame AS (SELECT DISTINCT layer, x0, y0, d FROM src),
    """


def lattice_sql(name: str, x: str, y: str, d: str, columns: str, rows: str, more: str = "") -> str:
    """Cells (row, col, px, py of the lower left corner) of a lattice, a common table expression."""
    return f"""{name} AS (
      SELECT c.col, r.row, {x} + c.col * {d} AS px, {y} + ({rows} - 1 - r.row) * {d} AS py
      FROM (SELECT cast(unnest(range(0, {columns})) AS int) AS col{more}) c JOIN (SELECT cast(unnest(range(0, {rows})) AS int) AS row{more}) r ON true)"""


def ask_sql(grid: str, at: str = "0") -> str:
    """layer, row, col and value at places of a lattice."""
    return f"""(SELECT a.layer, a.row, a.col, s.value FROM (
        SELECT layer, g.row, g.col, least(79, cast(floor((px + {at} - x0) / d) AS int)) AS sc, 69 - least(69, cast(floor((py + {at} - y0) / d) AS int)) AS sr
        FROM {grid} g JOIN frame ON px + {at} BETWEEN x0 AND x0 + 80 * d AND py + {at} BETWEEN y0 AND y0 + 70 * d) a
      JOIN src s ON s.layer = a.layer AND s.row = a.sr AND s.col = a.sc)"""


CUT = LAYERS + lattice_sql("grid", "120.0e0", "-40.0e0", "0.5e0", "40", "35")


@query("raster raster2 classes", CUT + f" SELECT layer, cast(row * 40 + col AS bigint) AS cell, row, col, value FROM {ask_sql('grid')}")
def cut_layers(raster, raster2, classes):
    return cutting.cut_layers(layers_of(raster, raster2, classes), 0.5)[1]


@query(
    "raster raster2 classes diamond ring",
    LAYERS
    + "area AS (SELECT cx, cy, greatest(cx - 5, 120) AS x, greatest(cy - 4.375e0, -40) AS y, least(cx + 5, 140) AS x9, least(cy + 4.375e0, -22.5e0) AS y9 FROM diamond WHERE oid = 7),"
    + "size AS (SELECT *, cast(ceil((x9 - x) / 0.375e0) AS int) AS columns, cast(ceil((y9 - y) / 0.375e0) AS int) AS rows FROM area),"
    + "grid AS (SELECT col, row, x + col * 0.375e0 AS px, y + (rows - 1 - row) * 0.375e0 AS py, cx, cy, columns FROM size JOIN (SELECT cast(unnest(range(0, 200)) AS int) AS col) ON col < columns JOIN (SELECT cast(unnest(range(0, 200)) AS int) AS row) ON row < rows),"
    + "kept AS (SELECT * FROM grid WHERE abs(greatest(px, least(cx, px + 0.375e0)) - cx) * 0.875e0 + abs(greatest(py, least(cy, py + 0.375e0)) - cy) < 4.375e0)"
    + f" SELECT layer, cast(row * (SELECT columns FROM size) + col AS bigint) AS cell, row, col, value FROM {ask_sql('kept')}",
)
def cut_layers_region(raster, raster2, classes, _, ring):
    return cutting.cut_layers(layers_of(raster, raster2, classes), 0.375, region=ring.where("oid = 7"))[1]


HELD = f"held AS (SELECT row, col FROM {ask_sql('grid', '0.25e0')} WHERE layer = 'el1' AND value BETWEEN 0 AND 150000 OR layer = 'el2' AND value BETWEEN 20000 AND 90000 GROUP BY ALL HAVING count(*) = 2)"


@query(
    "raster raster2 classes",
    CUT + f", {HELD}, ends AS (SELECT min(row) AS top, min(col) AS lft, max(col) AS rgt FROM held)"
    + f" SELECT layer, cast((row - top) * (rgt - lft + 1) + col - lft AS bigint) AS cell, row - top AS row, col - lft AS col, value FROM {ask_sql('grid')} JOIN held USING (row, col) JOIN ends ON true",
)
def cut_layers_envelope(raster, raster2, classes):
    layers = layers_of(raster, raster2, classes)
    return cutting.cut_layers(layers, 0.5, conditions=[cutting.Between(layers[0], 0, 150_000), cutting.Between(layers[1], 20_000, 90_000)])[1]


@query(
    "raster classes diamond ring",
    """src AS (SELECT layer, row, col, value, 112.0e0 AS x0, -44.0e0 AS y0, 0.5e0 AS d FROM raster), frame AS (SELECT DISTINCT layer, x0, y0, d FROM src),
    grid AS (SELECT cast(c AS int) AS col, cast(r AS int) AS row, 112.0e0 + c * 2 AS px, -44 + (17 - r) * 2.0e0 AS py FROM (SELECT unnest(range(0, 17)) AS c) JOIN (SELECT unnest(range(0, 18)) AS r) ON true)"""
    + f""" SELECT cast(row * 17 + col AS bigint) AS cell, row, col, round(radians(2) * abs(sin(radians(south + 2)) - sin(radians(south))) * pow(6378.137, 2), 3) AS km2
    FROM (SELECT a.row, a.col, -44 + (17 - a.row) * 2.0e0 AS south FROM {ask_sql('grid', '1')} a WHERE value BETWEEN 0 AND 150000)
    WHERE EXISTS (FROM diamond WHERE oid % 5 < 4 AND abs(113 + col * 2 - cx) * 0.875e0 + abs(south + 1 - cy) <= 4.375e0)""",
)
def envelope_coarsened(raster, _, diamond, ring):
    conditions = [cutting.Between(cutting.Layer(raster, LATTICE), 0, 150_000), cutting.Within(ring.where("oid % 5 < 4"))]
    return cutting.envelope_coarsened(conditions, 0.5, 200)[1].withColumn("km2", F.round("km2", 3))


def cached(raster, raster2, classes):
    """A cache of two layers of one lattice and one of another, in several files a group."""
    layers = {"el1": cutting.Layer(raster, LATTICE), "cl3": cutting.Layer(classes, FINE), "el2": cutting.Layer(raster2, LATTICE)}
    path = working_folder(raster.sparkSession, "grid-cache")
    grid_cache.build_cache(layers, path, 1 << 13)
    return path


@query(
    "occ raster raster2 classes",
    """src AS (
      SELECT layer, cell, value, 112.0e0 AS x0, -44.0e0 AS y0, 0.5e0 AS d FROM raster
      UNION ALL SELECT layer, cell, value, 112.0e0, -44.0e0, 0.5e0 FROM raster2
      UNION ALL SELECT layer, cell, value, 120.0e0, -40.0e0, 0.25e0 FROM classes),
    frame AS (SELECT DISTINCT layer, x0, y0, d FROM src),
    asked AS (
      SELECT pt, layer, CASE WHEN x BETWEEN x0 AND x0 + 80 * d AND y BETWEEN y0 AND y0 + 70 * d
        THEN (69 - least(69, floor((y - y0) / d))) * 80 + least(79, floor((x - x0) / d)) END AS cell FROM occ JOIN frame ON true)
    SELECT pt, layer, value FROM asked LEFT JOIN src USING (layer, cell)""",
)
def grid_cache_sample(occ, raster, raster2, classes):
    return grid_cache.sample_cache(occ.select("pt", "x", "y"), cached(raster, raster2, classes))


@query("raster raster2 classes", "SELECT layer, cast(cell AS bigint) AS cell, row, col, value FROM (FROM raster2 UNION ALL FROM classes) WHERE cell BETWEEN 1000 AND 2999")
def grid_cache_scan(raster, raster2, classes):
    return grid_cache.read_cache(raster.sparkSession, cached(raster, raster2, classes), ["el2", "cl3"], 1000, 3000)


SPLINE = "(CASE WHEN {0} < 1 THEN 2.0e0 / 3 - {0} * {0} + {0} * {0} * {0} / 2 WHEN {0} < 2 THEN pow(2 - {0}, 3) / 6 ELSE 0 END)"


@query(
    "raster",
    f"""tap AS (SELECT unnest(range(-3, 4)) AS k),
    cols AS (SELECT col, s, {SPLINE.format("abs((px - (112 + (s + 0.5e0) * 0.5e0)) / 0.5e0)")} AS w FROM (
      SELECT c AS col, px, cast(floor((px - 112) / 0.5e0) AS int) + k AS s FROM (SELECT c, 118.0e0 + (c + 0.5e0) * 0.375e0 AS px FROM (SELECT unnest(range(0, 96)) AS c)) JOIN tap ON true)),
    ups AS (SELECT up, s, {SPLINE.format("abs((py - (-44 + (s + 0.5e0) * 0.5e0)) / 0.5e0)")} AS w FROM (
      SELECT c AS up, py, cast(floor((py + 44) / 0.5e0) AS int) + k AS s FROM (SELECT c, -40.0e0 + (c + 0.5e0) * 0.375e0 AS py FROM (SELECT unnest(range(0, 88)) AS c)) JOIN tap ON true)),
    near AS (SELECT up, cols.col, sum(raster.value * cols.w * ups.w) AS total, sum(cols.w * ups.w) AS weight
      FROM raster JOIN cols ON cols.s = raster.col AND cols.w > 0 JOIN ups ON ups.s = 69 - raster.row AND ups.w > 0 GROUP BY ALL)
    SELECT 'el1' AS layer, cast((87 - up) * 96 + col AS bigint) AS cell, cast(87 - up AS int) AS row, cast(col AS int) AS col, round(total / weight, 3) AS value FROM near WHERE weight >= 1e-6""",
)
def raster_resample_spline(raster):
    found = resampling.resample_spline(cutting.Layer(raster, LATTICE), Lattice(118.0, -40.0, 0.375, 0.375, 96, 88))
    return found.withColumn("value", F.round("value", 3))
