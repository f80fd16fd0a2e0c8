"""Cuts over layers of several lattices, and envelopes on a lattice of bounded size.

Layers keep their own lattices. A result's lattice starts at the lower left corner
of what all layers share and has square cells; each of its cells asks a layer for
the value at one place, its lower left corner in a cut and its middle in a mask.
Which cells ask a layer's cell follows from that cell alone, so values move to
the new lattice without a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafacet.operators.rasters import Lattice, cell_states, mask_extent, region_mask

Box = tuple[float, float, float, float]
CORNER, MIDDLE = 0.0, 0.5


@dataclass(frozen=True)
class Layer:
    """A raster's cells (layer, cell, row, col, value) and their lattice."""

    cells: DataFrame
    lattice: Lattice


@dataclass(frozen=True)
class Between:
    """Places where a layer's value lies in a range, both ends included."""

    layer: Layer
    low: float
    high: float


@dataclass(frozen=True)
class Within:
    """Places in any object of a table of rings (oid, part, ring, i, x, y)."""

    rings: DataFrame


def box_of(lattice: Lattice) -> Box:
    """West, south, east and north of a lattice."""
    return lattice.x, lattice.y, lattice.x + lattice.dx * lattice.columns, lattice.y + lattice.dy * lattice.rows


def box_of_rings(rings: DataFrame) -> Box | None:
    """The box of all rings; None without any."""
    found = rings.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    return None if found[0] is None else tuple(map(float, found))


def shared_box(boxes: Iterable[Box | None]) -> Box | None:
    """What all boxes share; None if that is no area, or a box is missing."""
    given = list(boxes)
    if not given or None in given:
        return None
    x0, y0, x9, y9 = (f(b[k] for b in given) for k, f in enumerate((max, max, min, min)))
    return (x0, y0, x9, y9) if x0 < x9 and y0 < y9 else None


def lattice_over(box: Box, resolution: float) -> Lattice:
    """Square cells from a box's lower left corner on, as many as cover the box."""
    x0, y0, x9, y9 = box
    return Lattice(x0, y0, resolution, resolution, math.ceil((x9 - x0) / resolution), math.ceil((y9 - y0) / resolution))


def extents_text(lattice: Lattice) -> str:
    """Columns, rows, west, south, east and north, a line each."""
    return "\n".join(map(str, [lattice.columns, lattice.rows, *box_of(lattice)]))


def asked(number: Column, low: float, step: float, many: int, start: float, size: float, most: int, at: float) -> Column:
    """The numbers of those target cells of one axis whose asked place is in a source cell, an array.

    The source axis has `many` cells of `step` from `low` on, the target axis
    `most` of `size` from `start` on. A place at the source's end is in its last
    cell. Bounds are widened by a cell and each place is asked again as
    Lattice.cell asks it, so that rounding can't deal a place to two cells or none.
    """
    first = F.floor((F.lit(low) + number * step - start) / size - at) - 1
    last = F.ceil((F.lit(low) + (number + 1) * step - start) / size - at) + 1
    first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(most - 1))

    def here(n: Column) -> Column:
        place = F.lit(start) + (n + at) * size
        return (place >= low) & (place <= low + step * many) & (F.least(F.floor((place - low) / step), F.lit(many - 1)) == number)

    return F.when(first <= last, F.filter(F.sequence(first, last), here))


def onto(layer: Layer, target: Lattice, at: float = MIDDLE) -> DataFrame:
    """The layer's values on another lattice: layer, cell, row, col, value, no row where the layer has no data.

    The work grows with the layer's cells under the target and with the target's cells over them; nothing is shuffled.
    """
    own = layer.lattice
    west, south, east, north = box_of(target)
    # the source's rows and columns near the target, as numbers that a scan can prune by
    cols_near = math.floor((west - own.x) / own.dx) - 1, math.ceil((east - own.x) / own.dx) + 1
    ups_near = math.floor((south - own.y) / own.dy) - 1, math.ceil((north - own.y) / own.dy) + 1
    near = layer.cells.where(F.col("col").between(*cols_near) & F.col("row").between(own.rows - 1 - ups_near[1], own.rows - 1 - ups_near[0]))
    near = near.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("up", own.rows - 1 - F.col("row").cast("long"))
    cols = asked(F.col("col").cast("long"), own.x, own.dx, own.columns, target.x, target.dx, target.columns, at)
    ups = asked(F.col("up"), own.y, own.dy, own.rows, target.y, target.dy, target.rows, at)
    by_row = near.select("layer", "value", cols.alias("cols"), F.explode(ups).alias("up"))
    placed = by_row.select("layer", "value", "up", F.explode("cols").alias("col"))
    row = F.lit(target.rows - 1) - F.col("up")
    return placed.select("layer", target.number(row, F.col("col")).alias("cell"), row.cast("int").alias("row"), F.col("col").cast("int").alias("col"), "value")


def conditions_box(conditions: Iterable[Between | Within]) -> Box | None:
    """What the layers and areas of conditions share."""
    return shared_box(box_of(c.layer.lattice) if isinstance(c, Between) else box_of_rings(c.rings) for c in conditions)


def conditions_mask(conditions: list[Between | Within], target: Lattice) -> DataFrame:
    """cell, row and col of the cells whose middle meets every condition."""
    met = None
    for k, c in enumerate(conditions):
        cells = onto(c.layer, target).where(F.col("value").between(c.low, c.high)) if isinstance(c, Between) else region_mask(c.rings, target)
        one = cells.select("cell", "row", "col", F.lit(k).alias("k"))
        met = one if met is None else met.unionByName(one)
    return met.groupBy("cell", "row", "col").agg(F.count_distinct("k").alias("n")).where(F.col("n") == len(conditions)).select("cell", "row", "col")


def cut_layers(layers: list[Layer], resolution: float, region: DataFrame | None = None, conditions: list[Between | Within] | None = None) -> tuple[Lattice | None, DataFrame]:
    """Layers cut to what all of them share, on one lattice: it, and layer, cell, row, col and value of the cells with data.

    With a region (rings) the box is the region's too, and cells stay that it covers
    in part or in full. With conditions (of layers or areas) the cells stay whose
    middle meets all of them, and the lattice shrinks to those cells. One or the
    other may be given, or neither. Without a common area, or without a cell that
    meets the conditions, the lattice is None and there are no rows. A layer given
    twice is there twice; null and NaN values are no data.
    """
    if region is not None and conditions is not None:
        raise ValueError("a cut takes a region or conditions, not both")
    if not layers:
        raise ValueError("a cut needs a layer")
    boxes: list[Box | None] = [box_of(layer.lattice) for layer in layers]
    if region is not None:
        boxes.append(box_of_rings(region))
    if conditions:
        boxes.append(conditions_box(conditions))
    none = layers[0].cells.select("layer", F.col("cell").cast("long").alias("cell"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "value").limit(0)
    box = shared_box(boxes)
    if box is None:
        return None, none
    target, mask = lattice_over(box, resolution), None
    if region is not None:
        mask = cell_states(region, target).select("cell").distinct()
    elif conditions:
        held = conditions_mask(conditions, target)
        ends = mask_extent(held).first()  # one row
        if not ends["cells"]:
            return None, none
        whole = target
        target = Lattice(whole.x + ends["left"] * resolution, whole.y + (whole.rows - 1 - ends["bottom"]) * resolution, resolution, resolution, ends["right"] - ends["left"] + 1, ends["bottom"] - ends["top"] + 1)
        mask = held.select(target.number(F.col("row") - ends["top"], F.col("col") - ends["left"]).alias("cell"))
    found = None
    for layer in layers:
        one = onto(layer, target, CORNER)
        found = one if found is None else found.unionByName(one)
    return target, found if mask is None else found.join(mask, "cell", "left_semi").select("layer", "cell", "row", "col", "value")


def coarse_enough(box: Box, resolution: float, most: int) -> float:
    """The resolution, doubled until the box has at most twice `most` cells."""
    if most < 1:
        raise ValueError("an envelope needs room for a cell")
    while (box[2] - box[0]) / resolution * ((box[3] - box[1]) / resolution) > 2 * most:
        resolution *= 2
    return resolution


def envelope_coarsened(conditions: list[Between | Within], resolution: float, most: int) -> tuple[Lattice | None, DataFrame | None]:
    """Where all conditions are met, on a lattice of at most about twice `most` cells: it, and cell, row, col and km2 of each cell.

    Cells are square and doubled in width until they are few enough. Both are
    None if layers and areas of the conditions share no area. The envelope's area is the sum of km2.
    """
    box = conditions_box(conditions)
    if box is None:
        return None, None
    target = lattice_over(box, coarse_enough(box, resolution, most))
    return target, conditions_mask(conditions, target).select("cell", "row", "col", target.area(F.col("row")).alias("km2"))
