"""Hand-computed cases of geometry, rasters, facets and legends."""

import math

import pytest
from pyspark.sql import functions as F

from terrafacet.functions import measure
from terrafacet.operators import catalog, facets, legends, polygons, rasters

SQUARE = [(0, 0.0, 0.0), (1, 4.0, 0.0), (2, 4.0, 4.0), (3, 0.0, 4.0), (4, 0.0, 0.0)]
HOLE = [(0, 1.0, 1.0), (1, 3.0, 1.0), (2, 3.0, 3.0), (3, 1.0, 3.0), (4, 1.0, 1.0)]


def rings(spark, *ring, oid=1):
    return spark.createDataFrame([(oid, 0, k, i, x, y) for k, r in enumerate(ring) for i, x, y in r], "oid long, part int, ring int, i int, x double, y double")


def points(spark, *xy):
    return spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(xy)], "pt long, x double, y double")


@pytest.mark.parametrize("turned", [False, True])
def test_inside_outside_hole_edge_vertex(spark, turned):
    layer = rings(spark, *([r[::-1] if turned else r for r in (SQUARE, HOLE)]))
    if turned:
        layer = layer.withColumn("i", 4 - F.col("i"))
    cases = points(spark, (0.5, 0.5), (2.0, 2.0), (5.0, 2.0), (2.0, 0.0), (0.0, 0.0), (1.0, 1.0), (None, 1.0), (float("nan"), 1.0))
    assert {r.pt for r in polygons.contains(cases, layer).collect()} == {0, 3, 4, 5}


def test_first_hit_keeps_every_point_and_repeats(spark):
    layer = rings(spark, SQUARE, oid=7).unionByName(rings(spark, SQUARE, oid=3))
    found = polygons.first_hit(points(spark, (1.0, 2.0), (1.0, 2.0), (9.0, 9.0)), layer)
    assert {(r.pt, r.oid) for r in found.collect()} == {(0, 3), (1, 3), (2, None)}


def test_empty_layers(spark):
    none = rings(spark).limit(0)
    assert polygons.contains(points(spark, (1.0, 1.0)), none).count() == 0
    assert polygons.first_hit(points(spark, (1.0, 1.0)), none).collect()[0].oid is None


def test_near_is_zero_inside_and_plane_outside(spark):
    found = {r.pt: r.distance for r in polygons.near(points(spark, (2.0, 3.5), (5.0, 2.0), (7.0, 8.0), (9.0, 9.0)), rings(spark, SQUARE), 5.0).collect()}
    assert found == {0: 0.0, 1: 1.0, 2: 5.0}


def test_raster_edges_and_gaps(spark):
    lattice = rasters.Lattice(0.0, 0.0, 1.0, 1.0, 3, 2)
    cells = spark.createDataFrame([("a", k, k // 3, k % 3, float(k)) for k in range(5)], "layer string, cell int, row int, col int, value float")
    found = rasters.sample(points(spark, (0.0, 0.0), (3.0, 2.0), (3.01, 1.0), (2.5, 0.5), (1.5, 1.5)), cells, lattice)
    assert {r.pt: r.value for r in found.collect()} == {0: 3.0, 1: 2.0, 2: None, 3: None, 4: 1.0}


def test_constant_layer_standardises_to_null(spark):
    cells = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 1.0)], "layer string, cell int, value float")
    assert {r.value for r in rasters.standardise(cells).collect()} == {None}


def test_merge_missing_has_two_modes(spark):
    a = spark.createDataFrame([(0, 1.0), (1, None)], "cell int, value float")
    b = spark.createDataFrame([(1, 5.0), (2, 6.0)], "cell int, value float")
    assert {r.cell: r.value for r in rasters.merge_missing(a, b, True).collect()} == {0: 1.0, 1: 5.0, 2: 6.0}
    assert {r.cell: r.value for r in rasters.merge_missing(a, b, False).collect()} == {0: None, 1: None, 2: None}


def test_sphere(spark):
    one = spark.createDataFrame([([(0.0, 0.0), (90.0, 0.0), (0.0, 90.0), (0.0, 0.0)],)], "v array<struct<x double, y double>>")
    octant = one.select(measure.spherical_ring_area(F.col("v"))).first()[0]
    assert octant == pytest.approx(4 * math.pi * measure.EARTH_RADIUS**2 / 8, rel=1e-9)
    metres = one.select(measure.sphere_distance(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0))).first()[0]
    assert metres == pytest.approx(math.pi * measure.EARTH_RADIUS)


def test_cell_areas_sum_to_the_sphere(spark):
    total = spark.range(180).select(F.sum(measure.cell_area(0.5, F.col("id") * 0.5)) * 720 * 2).first()[0]
    assert total == pytest.approx(4 * math.pi * (measure.EARTH_RADIUS / 1000) ** 2, rel=1e-9)


RECORDS = [(1, "a", "5"), (2, "b", "n/a"), (3, None, "7"), (4, "a", ""), (5, "c d", None)]


@pytest.mark.parametrize(
    "text, kept",
    [
        ("k:a", {1, 4}), ("-k:a", {2, 3, 5}), ('k:"c d"', {5}), ("k:*", {1, 2, 4, 5}), ("-k:*", {3}), ("v:[5 TO 6]", {1}), ("-v:[5 TO 6]", {2, 3, 4, 5}),
        ("v:[* TO 7] AND k:a", {1}), ("k:b OR v:[6 TO *]", {2, 3}), ("-(k:a AND v:[5 TO *])", {2, 3, 4, 5}), ("-(k:a OR k:b)", {3, 5}), ("k:* AND -(k:a OR v:[7 TO 7])", {2, 5}),
    ],
)
def test_facets(spark, text, kept):
    df = spark.createDataFrame(RECORDS, "id int, k string, v string")
    facet = facets.parse(text)
    assert {r.id for r in df.where(facet.column()).collect()} == kept
    assert {r.id for r in df.where(~facet.column()).collect()} == {1, 2, 3, 4, 5} - kept


def test_facet_fields_and_errors():
    assert facets.fields_of(facets.parse("a:1 AND (b:2 OR a:3)")) == ["a", "b"]
    with pytest.raises(ValueError):
        facets.parse("no term")


@pytest.mark.parametrize("values, kind", [(["1", "2", "n/a"], "INT"), (["1", "9999999999"], "LONG"), (["1", "2.5"], "DOUBLE"), (["x", "2"], "STRING"), (["4"], "STRING"), ([], "STRING")])
def test_type_inference(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    assert catalog.infer_type(df, "c").first()["type"] == kind


def test_legend_sizes_cover_all_records(spark):
    df = spark.range(1000).select((F.col("id") % 37).cast("double").alias("v"))
    for cutoffs in (legends.even(df, "v"), legends.equal_area(df, "v"), legends.equal_size(df, "v")):
        assert legends.sizes(df, "v", cutoffs).agg(F.sum("records")).first()[0] == 1000


def test_names_without_subgenus(spark):
    df = spark.createDataFrame([("Macropus (Osphranter) rufus",), (None,)], "n string")
    assert [r[0] for r in df.select(catalog.without_subgenus(F.col("n"))).collect()] == ["Macropus rufus", None]
