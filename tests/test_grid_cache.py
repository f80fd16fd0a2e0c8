"""The grid cache: what it gives back, what it reads, and builds that meet readers."""

import os

import numpy as np
import pytest

from terrafacet.operators.cutting import Layer
from terrafacet.operators.rasters import Lattice
from terrafacet.sources import grid_cache

CELLS = "layer string, cell long, row int, col int, value float"
A, B = Lattice(0.0, 0.0, 1.0, 1.0, 7, 5), Lattice(2.0, 1.0, 0.3, 0.5, 6, 4)


def layer(spark, lattice, values):
    return Layer(spark.createDataFrame([("any", c, c // lattice.columns, c % lattice.columns, v) for c, v in values], CELLS), lattice)


@pytest.fixture(scope="module")
def held():
    """Values by layer and cell; every third cell has none."""
    return {(n, c): float(100 * k + c) for k, (n, lattice) in enumerate({"a": A, "b": B, "c": A}.items()) for c in range(lattice.columns * lattice.rows) if (c + k) % 3}


@pytest.fixture(scope="module")
def cache(spark, held, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cache"))
    layers = {n: layer(spark, lattice, [(c, v) for (m, c), v in held.items() if m == n]) for n, lattice in (("a", A), ("b", B), ("c", A))}
    grid_cache.build_cache(layers, path, 2 * 7 * 4 * 2)  # two raster rows of the first group a file
    return path


def asked(lattice, x, y):
    if x is None or y is None or not (lattice.x <= x <= lattice.x + lattice.dx * lattice.columns and lattice.y <= y <= lattice.y + lattice.dy * lattice.rows):
        return None
    return (lattice.rows - 1 - min(lattice.rows - 1, int((y - lattice.y) / lattice.dy))) * lattice.columns + min(lattice.columns - 1, int((x - lattice.x) / lattice.dx))


def test_groups(cache):
    first, second = grid_cache.groups_of(cache)
    assert (first.layers, first.lattice, first.rows) == (("a", "c"), A, 2) and (second.layers, second.lattice, second.rows) == (("b",), B, 4)


def test_samples_of_all_layers(spark, cache, held):
    draw = np.random.default_rng(1)
    places = [(k, float(x), float(y)) for k, (x, y) in enumerate(draw.uniform(-1, 8, (300, 2)))]
    places += [(900, 7.0, 5.0), (901, 0.0, 0.0), (902, None, 1.0), (903, float("nan"), 1.0), (904, 2.0, 1.0), (904, 2.0, 1.0), (None, 3.5, 2.5)]
    points = spark.createDataFrame(places, "pt long, x double, y double").repartition(3)
    found = sorted(((r.pt, r.layer, r.value) for r in grid_cache.sample_cache(points, cache).collect()), key=str)
    want = [(pt, n, held.get((n, asked(lattice, x, y)))) for pt, x, y in places for n, lattice in (("a", A), ("b", B), ("c", A))]
    assert found == sorted(want, key=str)


def test_one_record_a_place_is_read(spark, cache):
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.6, 0.4), (3, 6.5, 4.5), (4, 50.0, 50.0)], "pt long, x double, y double").coalesce(1)
    read = spark.sparkContext.accumulator(0)
    grid_cache.sample_cache(points, cache, read, gap_bytes=0).collect()
    assert read.value == 2 * 8  # two cells of the first group, none of the second


def test_plan_has_no_shuffle(spark, cache):
    points = spark.createDataFrame([(1, 0.5, 0.5)], "pt long, x double, y double")
    assert "Exchange" not in grid_cache.sample_cache(points, cache)._jdf.queryExecution().executedPlan().toString()


def test_gaps_are_read_over(cache):
    group = grid_cache.groups_of(cache)[0]
    apart, close = np.array([0, 3, 14, 34]), 4 * group.size
    values, read = grid_cache.records_at(group, apart, 0)
    same, more = grid_cache.records_at(group, apart, close)
    assert np.array_equal(values, same, equal_nan=True) and read == 4 * group.size and more == 6 * group.size
    assert grid_cache.records_at(group, apart[:0])[0].shape == (0, 2)


def test_scan_of_a_range_reads_no_other_cells(spark, cache, held, monkeypatch):
    found = {(r.layer, r.cell): (r.row, r.col, r.value) for r in grid_cache.read_cache(spark, cache).collect()}
    assert found == {(n, c): (c // w, c % w, v) for (n, c), v in held.items() for w in [6 if n == "b" else 7]}
    part = grid_cache.read_cache(spark, cache, ["c", "b"], 5, 20).collect()
    assert {(r.layer, r.cell): r.value for r in part} == {k: v for k, v in held.items() if k[0] in "bc" and 5 <= k[1] < 20}
    monkeypatch.setattr(grid_cache, "SCAN_BYTES", 40)
    reader = grid_cache.GridCacheReader(grid_cache.groups_of(cache)[0], 5, 99)
    assert [(p.first, p.end) for p in reader.partitions()] == [(k, min(k + 5, 35)) for k in range(5, 35, 5)]
    with pytest.raises(ValueError):
        grid_cache.read_cache(spark, cache, ["z"])


def test_a_build_replaces_the_one_before_and_leaves_its_files(spark, tmp_path):
    path = str(tmp_path)
    old = grid_cache.build_cache({"a": layer(spark, A, [(3, 1.0)])}, path)
    points = spark.createDataFrame([(1, 3.5, 4.5)], "pt long, x double, y double")
    before = grid_cache.sample_cache(points, path)
    # of several values the greatest, and NaN is none
    new = grid_cache.build_cache({"d": layer(spark, A, [(3, 2.0), (3, 7.0), (3, float("nan")), (4, None)])}, path)
    assert [(r.layer, r.value) for r in before.collect()] == [("a", 1.0)]
    assert [(r.layer, r.value) for r in grid_cache.sample_cache(points, path).collect()] == [("d", 7.0)]
    grid_cache.drop_old(path)
    assert not os.path.exists(old[0].files.format(0)) and os.path.exists(new[0].files.format(0))


def test_a_failed_build_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    grid_cache.build_cache({"a": layer(spark, A, [(3, 1.0)])}, path)
    before = grid_cache.groups_of(path)
    with pytest.raises(Exception, match="outside its lattice"):
        grid_cache.build_cache({"a": layer(spark, A, [(3, 2.0), (35, 1.0)])}, path)
    assert grid_cache.groups_of(path) == before


def test_no_layers_and_no_points(spark, tmp_path, cache):
    points = spark.createDataFrame([(1, 3.5, 4.5)], "pt long, x double, y double")
    assert grid_cache.build_cache({}, str(tmp_path)) == [] and grid_cache.sample_cache(points, str(tmp_path)).isEmpty() and grid_cache.read_cache(spark, str(tmp_path)).isEmpty()
    assert grid_cache.sample_cache(points.limit(0), cache).isEmpty()
    empty = grid_cache.build_cache({"a": layer(spark, A, [])}, str(tmp_path / "more"))
    assert len(empty) == 1 and [r.value for r in grid_cache.sample_cache(points, str(tmp_path / "more")).collect()] == [None]


def test_groups_of_one_file_each(spark, tmp_path):
    values = np.arange(70, dtype="<f4")
    values[6] = grid_cache.NO_DATA
    (tmp_path / "group_0.gri").write_bytes(values.tobytes())
    (tmp_path / "group_0.txt").write_text("one\ntwo\n")
    (tmp_path / "group_0.grd").write_text("[GeoReference]\nColumns=7\nRows=5\nMinX=0\nMaxX=7\nMinY=0\nMaxY=5\n[Data]\nDataType=FLOAT\n")
    points = spark.createDataFrame([(1, 3.5, 4.5)], "pt long, x double, y double")
    assert {r.layer: r.value for r in grid_cache.sample_cache(points, str(tmp_path)).collect()} == {"one": None, "two": 7.0}
    (tmp_path / "group_0.gri").write_bytes(values[:8].tobytes())
    with pytest.raises(Exception, match="too short"):
        grid_cache.read_cache(spark, str(tmp_path)).collect()
