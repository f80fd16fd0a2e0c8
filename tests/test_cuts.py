"""Cuts over layers of several lattices, against plain loops and at their edges."""

import math
import random

import pytest

from terrafacet.operators import cutting, resampling
from terrafacet.operators.rasters import Lattice

CELLS = "layer string, cell long, row int, col int, value float"


def layer(spark, name, lattice, value):
    found = [(name, r * lattice.columns + c, r, c, value(r, c)) for r in range(lattice.rows) for c in range(lattice.columns)]
    return cutting.Layer(spark.createDataFrame(found, CELLS), lattice)


def asked(lattice, value, x, y):
    """The value of a layer at a place, None off it."""
    if not (lattice.x <= x <= lattice.x + lattice.dx * lattice.columns and lattice.y <= y <= lattice.y + lattice.dy * lattice.rows):
        return None
    c, up = min(lattice.columns - 1, math.floor((x - lattice.x) / lattice.dx)), min(lattice.rows - 1, math.floor((y - lattice.y) / lattice.dy))
    return value(lattice.rows - 1 - up, c)


def grown(row, col):
    return None if (row * 5 + col) % 7 == 0 else float(row * 100 + col)


@pytest.mark.parametrize("at", [cutting.CORNER, cutting.MIDDLE])
def test_every_cell_of_a_lattice_asks_once(spark, at):
    # widths that no binary fraction holds, and lattices that end on each other's borders
    draw = random.Random(5)
    for _ in range(4):
        own = Lattice(draw.choice([-0.3, 0.1]), -0.7, draw.choice([0.1, 0.3, 0.7]), 0.2, 9, 8)
        to = Lattice(own.x + draw.choice([0, 0.1, -0.25]), -0.7, draw.choice([0.1, 0.15, 1 / 3]), draw.choice([0.05, 0.2, 0.6]), 11, 10)
        found = cutting.onto(layer(spark, "a", own, grown), to, at).collect()
        want = {}
        for r in range(to.rows):
            for c in range(to.columns):
                value = asked(own, grown, to.x + (c + at) * to.dx, to.y + (to.rows - 1 - r + at) * to.dy)
                if value is not None:
                    want[r, c] = value
        assert len(found) == len(want)
        assert {(f.row, f.col): f.value for f in found} == want and all(f.cell == f.row * to.columns + f.col for f in found)


def test_a_finer_lattice_needs_no_shuffle(spark):
    one = layer(spark, "a", Lattice(0, 0, 1, 1, 4, 4), grown)
    plan = cutting.onto(one, Lattice(0, 0, 0.25, 0.25, 16, 16))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_no_common_area_no_cells_and_no_layers(spark):
    a, b = layer(spark, "a", Lattice(0, 0, 1, 1, 3, 3), grown), layer(spark, "b", Lattice(3, 0, 1, 1, 3, 3), grown)
    rings = spark.createDataFrame([], "oid long, part int, ring int, i int, x double, y double")
    for more in ({}, {"region": rings}, {"conditions": [cutting.Between(b, 0, 9)]}):
        lattice, cells = cutting.cut_layers([a, b] if not more else [a], 1, **more)
        assert lattice is None and cells.columns == ["layer", "cell", "row", "col", "value"] and cells.isEmpty()
    lattice, cells = cutting.cut_layers([a], 1, conditions=[cutting.Between(a, 1e6, 2e6)])
    assert lattice is None and cells.isEmpty()
    assert cutting.envelope_coarsened([cutting.Between(a, 0, 9), cutting.Between(b, 0, 9)], 1, 10) == (None, None)
    with pytest.raises(ValueError):
        cutting.cut_layers([], 1)
    with pytest.raises(ValueError):
        cutting.cut_layers([a], 1, region=rings, conditions=[])


def test_gaps_nan_and_a_layer_given_twice(spark):
    a = layer(spark, "a", Lattice(0, 0, 1, 1, 2, 1), lambda r, c: (float("nan"), 3.0)[c])
    empty = cutting.Layer(a.cells.limit(0), a.lattice)
    lattice, cells = cutting.cut_layers([a, a, empty], 1)
    assert lattice == Lattice(0, 0, 1, 1, 2, 1)
    assert [tuple(c) for c in cells.collect()] == [("a", 1, 0, 1, 3.0)] * 2


def test_conditions_shrink_the_lattice(spark):
    a = layer(spark, "a", Lattice(10, 20, 1, 1, 5, 4), lambda r, c: float(10 * r + c))
    lattice, cells = cutting.cut_layers([a], 1, conditions=[cutting.Between(a, 11, 23)])  # from (1, 1) to (2, 3)
    assert lattice == Lattice(10, 21, 1, 1, 5, 2)
    assert sorted(c.value for c in cells.collect()) == [11, 12, 13, 14, 20, 21, 22, 23]
    assert cutting.extents_text(lattice).split("\n") == ["5", "2", "10", "21", "15", "23"]


def test_coarsening_stops_at_twice_the_size():
    assert cutting.coarse_enough((0, 0, 8, 8), 1, 32) == 1
    assert cutting.coarse_enough((0, 0, 8, 8), 1, 31) == 2
    assert cutting.coarse_enough((0, 0, 8, 8), 1, 1) == 8
    with pytest.raises(ValueError):
        cutting.coarse_enough((0, 0, 8, 8), 1, 0)


def spline(t):
    return 2 / 3 - t * t + t**3 / 2 if t < 1 else (2 - t) ** 3 / 6 if t < 2 else 0.0


@pytest.mark.parametrize("target", [Lattice(0.2, 0.1, 0.3, 0.45, 20, 12), Lattice(-1.0, -2.0, 2.5, 1.7, 4, 5), Lattice(0.0, 0.0, 1.0, 0.5, 7, 11)])
def test_spline_against_sums_over_all_cells(spark, target):
    own = Lattice(0.0, 0.0, 1.0, 0.5, 7, 11)
    values = lambda r, c: (None, float("nan"))[c % 2] if (r * 3 + c) % 5 == 0 or r in (3, 4, 5, 6, 7) and c < 5 else math.sin(r) * 10 + c
    found = {(f.row, f.col): f.value for f in resampling.resample_spline(layer(spark, "a", own, values), target).collect()}
    want = {}
    for r in range(target.rows):
        for c in range(target.columns):
            total = weight = 0.0
            for i in range(own.rows):
                for j in range(own.columns):
                    value = values(i, j)
                    wide, high = max(own.dx, target.dx), max(own.dy, target.dy)
                    across = abs(target.x + (c + 0.5) * target.dx - own.x - (j + 0.5) * own.dx) / wide
                    up = abs(target.y + (target.rows - r - 0.5) * target.dy - own.y - (own.rows - i - 0.5) * own.dy) / high
                    w = spline(across) * spline(up) * own.dx / wide * own.dy / high
                    if value is not None and value == value:
                        total, weight = total + w * value, weight + w
            if weight >= resampling.LEAST_WEIGHT:
                want[r, c] = total / weight
    assert set(found) == set(want) and all(found[k] == pytest.approx(want[k], rel=1e-6, abs=1e-6) for k in want)
    assert resampling.resample_spline(layer(spark, "a", own, lambda r, c: None), target).isEmpty()
