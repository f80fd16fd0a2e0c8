"""Text forms of areas, exact overlay, files of rasters and records, and row-changing operators, on small cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafacet.functions import colours, wkt
from terrafacet.operators import catalog, facets, outlines, overlay, polygons, rasters, sampling, simplify, sphere, tabulation, tiles, validity
from terrafacet.sources import grids, records
from terrafacet.session import written

SQUARE = "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 2,1 1))"


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("v")).first().v


def test_wkt_forms(spark):
    text = F.col("t")
    assert one(spark, wkt.to_wkt(wkt.from_wkt(text)), t="multipolygon (((0 0, 1 0,1 1, 0 0)),((5 5,6 5,6 6,5 5)))") == "MULTIPOLYGON(((0.0 0.0,1.0 0.0,1.0 1.0,0.0 0.0)),((5.0 5.0,6.0 5.0,6.0 6.0,5.0 5.0)))"
    assert one(spark, wkt.plane_area(wkt.from_wkt(text)), t=f"GEOMETRYCOLLECTION({SQUARE},MULTIPOLYGON(((5 5,6 5,6 6,5 5))))") == 15.5
    assert one(spark, wkt.collection_parts(text), t=f"GEOMETRYCOLLECTION(POINT(1 2), {SQUARE},MULTIPOLYGON(((5 5,6 5,6 6,5 5))))") == ["POINT(1 2)", SQUARE, "MULTIPOLYGON(((5 5,6 5,6 6,5 5)))"]
    for bad in ("POLYGON((0 0,1 1,0 0))", "POLYGON((0 0,1 0,1 1,0 1))", "POLYGON((0 0,1 0,1 x,0 0))", "POINT(1 2)", "", "POLYGON((0 0,1 0,1 1,0 0)"):
        assert one(spark, wkt.wkt_valid(text), t=bad) is False
    assert one(spark, wkt.wkt_valid(text), t=SQUARE) is True and one(spark, wkt.from_wkt(text.cast("string")), t=None) is None
    assert one(spark, wkt.from_geojson(text), t='{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]}') is None
    assert one(spark, wkt.to_wkt(wkt.from_geojson(text)), t='{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]]]}') == "POLYGON((0.0 0.0,1.0 0.0,1.0 1.0,0.0 0.0))"


def edges(ring):
    return np.array([[*a, *b] for a, b in zip(ring, ring[1:])], float)


def rings_frame(spark, objects):
    """Rings from {oid: [[ring, ...] of a part, ...]}, closed on the way."""
    rows = [(oid, p, r, i, float(x), float(y)) for oid, parts in objects.items() for p, rings in enumerate(parts) for r, ring in enumerate(rings) for i, (x, y) in enumerate([*ring, ring[0]])]
    return spark.createDataFrame(rows, "oid long, part int, ring int, i int, x double, y double")


def square(x, y, w, h=None):
    return [(x, y), (x + w, y), (x + w, y + (h or w)), (x, y + (h or w))]


def covered(parts, x, y):
    def inside(ring):
        e = edges([*ring, ring[0]])
        with np.errstate(divide="ignore", invalid="ignore"):
            return (((e[:, 0] > x) != (e[:, 2] > x)) & (e[:, 1] + (x - e[:, 0]) * (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0]) > y)).sum() % 2 == 1

    return any(sum(map(inside, rings)) % 2 for rings in parts)


def stars(rng, parts, corners, grid=None):
    found = []
    for _ in range(parts):
        turn, (cx, cy) = np.sort(rng.random(corners)) * 2 * math.pi, rng.normal(size=2)
        ring = [(cx + 2 * r * math.cos(t), cy + 2 * r * math.sin(t)) for t, r in zip(turn, 0.3 + 0.7 * rng.random(corners))]
        found.append([[(round(x / grid) * grid, round(y / grid) * grid) for x, y in ring] if grid else ring])
    return found


def test_shared_area_of_overlapping_parts_against_a_fine_lattice(spark):
    rng = np.random.default_rng(4)
    first, second = {1: stars(rng, 3, 9), 2: stars(rng, 1, 30)}, {7: stars(rng, 2, 12), 8: stars(rng, 2, 8, 0.5)}
    step = 0.05
    at = np.arange(-5, 5, step) + step / 2
    held = {k: np.array([[covered(parts, x, y) for y in at] for x in at]) for k, parts in (first | second).items()}
    found = {(r.oid_a, r.oid_b): r.degrees2 for r in overlay.overlay_areas(rings_frame(spark, first), rings_frame(spark, second)).collect()}
    for a in first:
        for b in second:
            assert found.get((a, b), 0) == pytest.approx((held[a] & held[b]).sum() * step * step, abs=0.15)


def test_parts_of_an_object_are_united(spark):
    two = {1: [[square(0, 0, 2)], [square(1, 0, 2)]], 3: [[square(20, 20, 1)]]}
    found = overlay.overlay_areas(rings_frame(spark, two), rings_frame(spark, {2: [[square(-5, -5, 20)]]})).collect()
    assert [(r.oid_a, r.oid_b, r.degrees2) for r in found] == [(1, 2, 6.0)]
    assert overlay.overlay_areas(rings_frame(spark, two).limit(0), rings_frame(spark, two)).collect() == []


def test_cut_tiles_give_the_areas_of_whole_ones(spark, monkeypatch):
    """The same pairs with pieces of 8 edges at most, on lattice coordinates that meet tile corners, and with three layers."""
    rng = np.random.default_rng(6)
    layers = [{k: stars(rng, 2, 40, g) for k in range(2)} for g in (None, 0.25, 0.5)]
    frames = [rings_frame(spark, x) for x in layers]
    rounded = lambda: sorted((r.oid_a, r.oid_b, r.oid_c, round(r.degrees2, 6)) for r in overlay.overlay_areas(*frames).collect())
    whole = rounded()
    monkeypatch.setattr(tiles, "PIECE_EDGES", 8)
    monkeypatch.setattr(tiles, "MOST_CUTS", 2)
    assert rounded() == whole and len(whole) == 8


def test_large_outlines(spark):
    """Rings of 20 000 vertices against the sum over one tile that holds them whole."""
    rng, n, outlines_ = np.random.default_rng(1), 20_000, []
    for cx in (0, 1.5):
        turn = np.linspace(0, 2 * math.pi, n, endpoint=False)
        r = 5 * (1 + 0.05 * np.sin(37 * turn) + 0.0005 * rng.random(n))
        outlines_.append(list(zip((cx + r * np.cos(turn)).tolist(), (r * np.sin(turn)).tolist())))
    found = overlay.overlay_areas(*(rings_frame(spark, {k: [[ring]]}) for k, ring in enumerate(outlines_))).collect()
    objects = []
    for ring in outlines_:
        e = edges([*ring, ring[0]])
        objects.append(([np.zeros(n, int), *e.T], np.zeros(0, int)))
    t = overlay.shared_in_tile(objects, (-16, -16, 16, 16))
    assert [r.degrees2 for r in found] == [pytest.approx((((t.high0 - t.low0) + (t.high1 - t.low1)) / 2 * (t.x1 - t.x0)).sum(), abs=1e-7)]


def test_validity_of_texts(spark):
    outer = "(0 0,9 0,9 9,0 9,0 0)"
    cases = {
        "POLYGON((0 0,1 0,1 1,0 0))": True,
        " polygon ( ( 0 0 , 1 0, 1 1e0,0  0 ) ) ": True,
        "POLYGON((0 0,1 0,1 1,0 0)) hello": False,
        "POLYGON((0 0,1 0,1 1,0 0)),1 1": False,
        "POLYGON((0 0,1 1,1 0,0 1,0 0))": False,  # bow tie
        f"POLYGON({outer},(2 2,4 2,4 4,2 4,2 2))": True,
        f"POLYGON({outer},(0 0,4 2,4 4,0 0))": True,  # a hole touches in a point
        f"POLYGON({outer},(0 0,4 0,4 4,0 0))": False,  # along a side
        f"POLYGON({outer},(8 8,12 8,12 12,8 12,8 8))": False,
        f"POLYGON({outer},(1 1,5 1,5 5,1 5,1 1),(2 2,3 2,3 3,2 3,2 2))": False,  # a hole in a hole
        f"POLYGON({outer},(1 1,3 1,3 3,1 3,1 1),(3 3,5 3,5 5,3 5,3 3))": True,
        "POLYGON((0 0,4 0,4 4,2 0,0 4,0 0))": False,  # a vertex on another edge
        "POLYGON((0 0,4 0,2 2,4 4,0 4,2 2,0 0))": False,  # twice through a point
        "POLYGON((0 0,4 0,6 0,4 0,4 4,0 0))": False,  # a spike
        "POLYGON((0 0,0 0,1 0,1 1,0 0))": True,  # a repeated point
        f"MULTIPOLYGON(({outer}),((20 0,21 0,21 1,20 0)))": True,
        f"MULTIPOLYGON(({outer}),((9 0,21 0,21 1,9 0)))": True,  # a common corner
        f"MULTIPOLYGON(({outer}),((9 0,21 0,9 9,9 0)))": False,  # a common side
        f"MULTIPOLYGON(({outer},(2 2,7 2,7 7,2 7,2 2)),((3 3,4 3,4 4,3 3)))": True,  # an island
        f"MULTIPOLYGON(({outer}),((20 0,30 0,30 10,20 10,20 0),(2 2,3 2,3 3,2 2)))": False,  # a hole in another part
        "GEOMETRYCOLLECTION(POINT(1 2),POLYGON((0 0,1 0,1 1,0 0)),LINESTRING(0 0,1 1))": True,
        "GEOMETRYCOLLECTION(POINT(1 2 3),POLYGON((0 0,1 0,1 1,0 0)))": False,
        "POLYGON((#,1 0,1 1,0 0))": False,
        "POINT(1 2)": False,
        "": False,
        None: False,
    }
    texts = spark.createDataFrame(list(enumerate(cases)), "oid long, wkt string")
    assert {k: r.valid for k, r in zip(cases, sorted(validity.valid_areas(texts).collect()))} == cases


def test_radius_join_over_the_date_line_and_the_poles(spark):
    rng = np.random.default_rng(2)
    x, y = rng.uniform(-180, 180, 400), np.degrees(np.arcsin(rng.uniform(-1, 1, 400)))
    x[:8], y[:8] = [180, -180, 179.99, -179.99, 0, 90, 0, 540], [0, 0, 10, 10, 90, 90, -90, 0]
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))]
    odd = [(900, None, 1.0), (901, 1.0, float("nan")), (902, 1.0, 91.0), (None, 0.5, 0.5)]
    frame = lambda name: spark.createDataFrame(rows + odd[:3], f"{name} long, x double, y double")

    def far(a, b):
        (x1, y1), (x2, y2) = ((math.radians(p[1]), math.radians(p[2])) for p in (a, b))
        return 2 * math.asin(math.sqrt(min(1, math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2))) * 6_378_137

    for metres in (500.0, 700_000.0, 9_000_000.0):
        found = {(r.pt, r.pid) for r in sphere.within_radius(frame("pt"), frame("pid"), metres).collect()}
        assert found == {(a[0], b[0]) for a in rows for b in rows if far(a, b) <= metres}


def test_busy_cells_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(sphere, "CELL_ROWS", 10)
    places = spark.range(100).selectExpr("id AS pt", "id / 1000 AS x", "0.0 AS y")
    assert sphere.within_radius(places, places.selectExpr("pt AS pid", "x", "y"), 1e5).count() == 10_000


def test_both_sides_of_busy_cells_are_dealt_out(spark, monkeypatch):
    """Dealing one side alone sent all 400 objects to each of 100 shares: 40 000 rows on their way."""
    monkeypatch.setattr(sphere, "CELL_PAIRS", 1600)
    places = spark.range(400).selectExpr("id AS pt", "id / 1000 AS x", "0.0 AS y")
    sent, repartition = [], type(places).repartition
    monkeypatch.setattr(type(places), "repartition", lambda df, *by: (sent.append(df), repartition(df, *by))[1])
    found = sphere.within_radius(places, places.selectExpr("pt AS pid", "x", "y"), 1e5)
    assert found.distinct().count() == found.count() == 160_000
    assert [df.count() <= 20_000 for df in sent] == [True, True]
    key = ["band", "column", "places", "objects"]
    groups = sent[0].groupBy(key).agg(F.count("*").alias("n")).join(sent[1].groupBy(key).agg(F.count("*").alias("m")), key)
    assert groups.agg(F.max(F.col("n") * F.col("m"))).first()[0] <= 4 * 1600


def test_lattices_beyond_31_bits(spark):
    """The whole world at 0.0025 degrees: 10 ** 10 cells."""
    world = rasters.Lattice(-180.0, -90.0, 0.0025, 0.0025, 144_000, 72_000)
    places = spark.createDataFrame([(1, 180.0, -90.0), (2, -180.0, 90.0), (3, 181.0, 0.0), (4, None, 0.0), (5, 0.001, 0.001)], "pt long, x double, y double")
    cells = spark.createDataFrame([("el1", 144_000 * 72_000 - 1, 7.0), ("el1", 0, 8.0)], "layer string, cell long, value float")
    found = {r.pt: r.value for r in rasters.sample(places, cells, world).collect()}
    assert found == {1: 7.0, 2: 8.0, 3: None, 4: None, 5: None}
    small = rings_frame(spark, {1: [[square(100.0, -80.0, 0.01)]]})
    mask = rasters.region_mask(small, world).collect()
    assert len(mask) == 16 and {r.cell for r in mask} == {r.row * 144_000 + r.col for r in mask}
    assert {r.col for r in mask} == set(range(112_000, 112_004))


def test_filled_cells_equal_the_test_of_every_middle(spark):
    lattice = rasters.Lattice(-5.0, -5.0, 0.25, 0.5, 40, 20)
    rng = np.random.default_rng(7)
    objects = {1: stars(rng, 2, 9), 2: stars(rng, 1, 12, 0.125), 3: [[square(-1, -1, 3), square(-0.5, -0.5, 1)]], 4: [[square(-0.875, -0.75, 0.25, 0.5)]]}
    middles = spark.createDataFrame([(r * 40 + c, -5 + (c + 0.5) * 0.25, -5 + (19 - r + 0.5) * 0.5) for r in range(20) for c in range(40)], "pt long, x double, y double")
    want = {(r.oid, r.pt) for r in polygons.contains(middles, rings_frame(spark, objects)).collect()}
    assert {(r.oid, r.cell) for r in rasters.filled(rings_frame(spark, objects), lattice).collect()} == want


def test_relations_of_objects_that_touch_nest_and_miss(spark):
    first = {1: [[square(0, 0, 1)]], 2: [[square(3, 3, 1)]], 3: [[square(10, 10, 4), square(11, 11, 2)]], 4: [[square(0, 5, 1)], [square(3.25, 3.25, 0.5)]], 5: [[square(100, 0, 1)]]}
    second = {11: [[square(1, 1, 2)]], 12: [[square(1, 0, 1)]], 13: [[square(2.5, 2.5, 2)]], 14: [[square(11, 11, 2)]], 15: [[square(11.5, 11.5, 1)]], 16: [[square(101 + 2**-40, 0, 1)]], 17: [[square(-1, 4, 20)]]}
    found = {(r.oid_a, r.oid_b): r.within for r in overlay.relations(rings_frame(spark, first), rings_frame(spark, second)).collect()}
    assert found == {(1, 11): False, (1, 12): False, (2, 11): False, (2, 13): True, (4, 13): False, (3, 14): False, (4, 17): False, (3, 17): True, (2, 17): False}
    backwards = {(r.oid_b, r.oid_a) for r in overlay.relations(rings_frame(spark, second), rings_frame(spark, first)).collect()}
    assert backwards == set(found)


@pytest.mark.parametrize("kind,big", [("BYTE", False), ("UBYTE", False), ("SHORT", True), ("INT", False), ("LONG", True), ("FLOAT", False), ("FLOAT", True), ("DOUBLE", True)])
def test_raster_files_of_every_type_and_byte_order(spark, tmp_path, kind, big):
    lattice = rasters.Lattice(112.0, -44.0, 0.5, 0.25, 7, 5)
    cells = [("el9", k, k // 7, k % 7, float(k)) for k in range(35) if k != 11]
    frame = spark.createDataFrame(cells, "layer string, cell long, row int, col int, value float")
    header = grids.Header(lattice, kind, big, 99.0)
    grids.write_grid(frame, str(tmp_path / "g"), header)
    read, found = grids.read_grid(spark, str(tmp_path / "g"), "el9")
    assert (read.lattice, read.kind, read.big) == (lattice, kind, big)
    rows = sorted(tuple(r) for r in found.collect())
    assert rows == sorted([*cells, ("el9", 11, 1, 4, None)], key=lambda r: r[:4])


def test_header_units_rescale():
    assert [grids.rescale_of(u) for u in ("1/10 mm", "x0.1 mm", "mm", "", "xy z")] == [0.1, 0.1, 1.0, 1.0, 1.0]
    with pytest.raises(ValueError):
        grids.parse_header("[General]\nColumns=1\nRows=1\nMinX=0\nMaxX=1\nMinY=0\nMaxY=1\nDataType=odd\n")


def test_record_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text("longitude,names_and_lsid,year,latitude\n1.5,a,2001,2.5\n1,b,x,2\nshort,row\n9,c,1999,9\n")
    rows = sorted(tuple(r) for r in records.read_records(spark, str(tmp_path / "r.csv")).collect())
    assert rows == [("a", 1.5, 2.5, 2001), ("c", 9.0, 9.0, 1999)]
    ring = spark.createDataFrame([(1, 0, 0, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)])], "oid long, part int, ring int, i int, x double, y double")
    assert [r.species for r in records.read_records(spark, str(tmp_path / "r.csv"), ring).collect()] == ["a"]
    (tmp_path / "p.csv").write_text("-30.5,120.25\n1,2\n")
    assert sorted(tuple(r) for r in records.read_points(spark, str(tmp_path / "p.csv")).collect()) == [(2.0, 1.0), (120.25, -30.5)]
    samples = spark.createDataFrame([("a,b", -30.0, 120.0, None)], "el1 string, latitude double, longitude double, el2 string")
    records.write_samples(samples.coalesce(1), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("*.csv")).read_text() == 'latitude,longitude,el1,el2\n-30.0,120.0,"a,b",\n'


def test_sampling_does_not_multiply_repeated_points(spark):
    lattice = rasters.Lattice(0.0, 0.0, 1.0, 1.0, 2, 2)
    cells = spark.createDataFrame([("a", 2, 1.0), ("b", 2, 2.0)], "layer string, cell int, value float")
    points = spark.createDataFrame([(1, 0.5, 0.5)] * 2 + [(2, 9.0, 9.0), (None, None, None)], "pt long, x double, y double")
    found = sorted(map(str, rasters.sample(points, cells, lattice).collect()))
    assert len(found) == 8 and sum("value=1.0" in r for r in found) == 2 and sum("value=None" in r for r in found) == 4


def test_tabulating_does_not_multiply_repeated_records(spark):
    records = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a")], "pt int, species string")
    first = spark.createDataFrame([(1, "p"), (1, "p"), (1, "q"), (2, "p")], "pt int, oid string")
    second = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x")], "pt int, oid string")
    want = {("p", "x", 3, 2), ("q", "x", 3, 2)}
    assert {tuple(r) for r in tabulation.species_pairs(records, first, second).collect()} == want
    totals = tabulation.species_totals(records, first, second).select("pid1", "pid2", "occurrences", "species", "speciest1", "speciest2")
    assert {tuple(r) for r in totals.collect()} == {(*w, 2, 2) for w in want}


def test_facet_bounds_text_and_mixed_operators():
    facet = facets.parse("a:[1 TO 5] OR a:[3 TO 9] OR b:[* TO 2] OR c:x")
    assert facets.bounds_of(facet) == {"a": (1.0, 9.0), "b": (None, 2.0)}
    assert facets.parse(facets.text_of(facet)) == facet
    with pytest.raises(ValueError):
        facets.parse("a:1 AND b:2 OR c:3")
    assert facets.layer_filters("ENVELOPE(el1,1,2:cl22,a,b)")[1].ids == ("a", "b")


def test_colours(spark):
    value = F.col("v0").cast("double")
    ramp = lambda v: one(spark, colours.rgb_text(colours.ramp(value, F.lit(0.0), F.lit(10.0))), v0=v)
    assert [ramp(v) for v in (0.0, 10.0, 5.5, 11.0, float("nan"))] == ["0,45,208", "255,0,0", "207,255,0", "255,255,255", "255,255,255"]
    assert one(spark, colours.rgb_text(colours.linear(value, F.lit(0.0), F.lit(2.0), 0x000000, 0xFF8040)), v0=1.0) == "127,64,32"


def test_tasks_and_user_data(spark):
    schema = "id long, name string, json string, size int, created timestamp, started timestamp, finished timestamp"
    now = F.lit("2020-01-02").cast("timestamp")
    tasks = spark.createDataFrame([(1, "a", "{}", 1, None, None, None)], schema)
    more = catalog.add_task(tasks, spark.createDataFrame([(2, "a", "{}", 1, None, None, None), (3, "b", None, 1, None, None, None)], schema))
    assert sorted(r.id for r in more.collect()) == [1, 3]
    begun = catalog.start_tasks(more, spark.createDataFrame([(3,)], "id long"), now)
    assert [r.id for r in begun.where("started is not null").collect()] == [3]
    assert catalog.reset_tasks(begun).where("started is not null").isEmpty()
    refs = spark.createDataFrame([(7, "x", "a"), (7, "x", "b f1"), (7, "y", "c"), (8, "x", "d")], "header long, data_type string, ref string")
    assert [r.ref for r in catalog.list_refs(refs, "7", "x").collect()] == ["a"] and [r.ref for r in catalog.list_refs(refs, "7:f1", "x").collect()] == ["b"]
    heads = spark.createDataFrame([(1, "Old birds", "u"), (2, "new", "u"), (3, "old BIRDS", "v")], "id long, description string, user_id string")
    assert [r.id for r in catalog.user_data_search(heads, {"description": "old%"}, {"user_id": "u"}).collect()] == [1]
    kept = catalog.delete_rows(heads, heads.where("id = 2"), ["id"])
    assert kept.columns == heads.columns and sorted(r.id for r in kept.collect()) == [1, 3]


def test_outlines_of_holes_corner_touches_and_repeats(spark):
    #  a ring of cells that touches itself by a corner alone, and a lone cell beside it
    picture = ["XXX.", "X.X.", "XX.X", "...."]
    cells = [(1 if (r, c) != (2, 3) else 9, r, c) for r, line in enumerate(picture) for c, x in enumerate(line) if x == "X"]
    frame = spark.createDataFrame([*cells, cells[0], (None, 0, 0), (1, None, 0)], "component int, row int, col int")
    found = outlines.outlines(frame, rasters.Lattice(10.0, 20.0, 1.0, 1.0, 4, 4))
    texts = {r.oid: r.t for r in overlay.areas_of(found).select("oid", wkt.to_wkt(F.col("geometry")).alias("t")).collect()}
    assert texts[9] == "POLYGON((13.0 21.0,14.0 21.0,14.0 22.0,13.0 22.0,13.0 21.0))"
    assert texts[1].count("(") == 3 and texts[1].endswith(",(11.0 22.0,11.0 23.0,12.0 23.0,12.0 22.0,11.0 22.0))")
    assert one(spark, wkt.plane_area(wkt.from_wkt(F.col("t"))), t=texts[1]) == 7.0
    assert outlines.outlines(frame.limit(0), rasters.Lattice(0.0, 0.0, 1.0, 1.0, 4, 4)).count() == 0


def test_cell_states_of_a_slanted_shape(spark):
    ring = [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 0.0)]
    rings = spark.createDataFrame([(1, 0, 0, i, x, y) for i, (x, y) in enumerate(ring)], "oid long, part int, ring int, i int, x double, y double")
    found = {(r.row, r.col): r.state for r in rasters.cell_states(rings, rasters.Lattice(0.0, 0.0, 1.0, 1.0, 4, 3)).collect()}
    assert found == {(2, 0): "partial", (1, 1): "partial", (0, 2): "partial", (2, 1): "full", (2, 2): "full", (1, 2): "full"}


def test_analysis_layer_ids(spark):
    cases = {
        "species_12": ("12", "maxent/12/12", "Prediction"),
        "aloc_a_b": ("a_b", "aloc/a_b/aloc", "Classification"),
        "odensity_7": ("7", "sitesbyspecies/7/occurrence_density", "Occurrence Density"),
        "7_srichness": ("7", "sitesbyspecies/7/species_richness", "Species Richness"),
        "1_2_odensity": ("1", "gdm/1/2_odensityTran", "Transformed 2_odensity"),
        "envelope_9": ("9", "envelope/9/envelope", "Environmental Envelope"),
        "gdm_el1Tran_33": ("33", "gdm/33/el1Tran", "Transformed el1"),
        "33_el1": ("33", "gdm/33/el1Tran", "Transformed el1"),
        "el1": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "id string").select("id", sampling.analysis_layer(F.col("id")).alias("a")).collect()
    assert {r.id: r.a and tuple(r.a) for r in rows} == cases


def test_rows_at_one_place_are_measured_together(spark, monkeypatch):
    monkeypatch.setattr(sphere, "PLACE_ROWS", 8)
    monkeypatch.setattr(sphere, "CELL_PAIRS", 100)
    rows = [(None if k == 7 else k, (k % 3) / 1000, 0.0 if k % 2 else -0.0) for k in range(60)]
    places, objects = (spark.createDataFrame(rows, f"{name} long, x double, y double") for name in ("pt", "pid"))
    near, placed = sphere._gathered(places, "pt"), sphere.within_radius(places, objects, 150.0, digits=2)
    assert 3 < near.count() < 30
    found = sorted(((r.pt if r.pt is not None else -1, r.pid if r.pid is not None else -1, r.metres) for r in placed.collect()))
    at = lambda k: k if k != 7 else -1
    assert found == sorted((at(a), at(b), round(math.radians(abs(a % 3 - b % 3) / 1000) * 6_378_137, 2)) for a in range(60) for b in range(60) if abs(a % 3 - b % 3) < 2)


def plain_outline(x, y, tolerance):
    stay, spans = {0, len(x) - 1}, [(0, len(x) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a > 1:
            d = simplify._away_all(x[a + 1 : b], y[a + 1 : b], (x[a], y[a]), (x[b], y[b]))
            if d.max() > tolerance:
                k = a + 1 + int(d.argmax())
                stay.add(k)
                spans += [(a, k), (k, b)]
    return stay


def test_the_farthest_vertex_by_boxes_of_blocks():
    rng = np.random.default_rng(4)
    for y in (rng.integers(0, 50, 6000) / 8, rng.integers(0, 2, 6000) * 2.0, np.cumsum(rng.normal(size=6000))):
        x = np.arange(6000) / 8
        find = simplify.farthest(x, y)
        for a, b in ((0, 5999), (17, 5000), (255, 4096), (256, 4097), (0, 2), (300, 900)):
            d = simplify._away_all(x[a + 1 : b], y[a + 1 : b], (x[a], y[a]), (x[b], y[b]))
            assert find(a, b) == (d.max(), a + 1 + int(d.argmax()))


@pytest.mark.parametrize("span_rows", [1 << 19, 250])
def test_a_ring_cut_at_one_end_takes_few_rounds(spark, monkeypatch, span_rows):
    """Each cut of the zigzag is near its beginning; spans that one task ends and spans cut by rounds keep the same vertices."""
    y = np.random.default_rng(4).integers(0, 50, 300) / 8
    frame = spark.range(300).select(F.lit(1).alias("oid"), F.lit(0).alias("part"), F.lit(0).alias("ring"), F.col("id").cast("int").alias("i"), (F.col("id") / 8).alias("x"), F.get(F.lit(y.tolist()), F.col("id").cast("int")).alias("y"))
    rounds = []
    monkeypatch.setattr(simplify, "SPAN_ROWS", span_rows)
    monkeypatch.setattr(simplify, "written", lambda df: rounds.append(1) or written(df))
    found = {r.i for r in simplify.simplified(frame, 1.5).collect()}
    assert len(rounds) <= (2 if span_rows > 300 else 24)
    assert found == plain_outline(np.arange(300) / 8, y, 1.5)
