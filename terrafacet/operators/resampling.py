"""Cubic-spline resampling of a raster onto another lattice, one axis after the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafacet.operators.cutting import Layer
from terrafacet.operators.rasters import Lattice

#: The sum of weights, of 1, below which a cell has too little data near it for a value.
LEAST_WEIGHT = 1e-6


def spline(t: Column) -> Column:
    """The cubic B-spline at a distance t of 0 or more; nothing from 2 on."""
    near = 2 / 3 - t * t + t * t * t / 2
    return F.when(t < 1, near).when(t < 2, F.pow(2 - t, F.lit(3)) / 6).otherwise(0.0)


def reached(number: Column, low: float, step: float, start: float, size: float, most: int) -> Column:
    """to and weight of the target cells of one axis that a source cell has a share in, an array; coarser targets reach as much wider."""
    reach = max(step, size)
    middle = F.lit(low) + (number + 0.5) * step
    first = F.greatest(F.ceil((middle - 2 * reach - start) / size - 0.5), F.lit(0))
    last = F.least(F.floor((middle + 2 * reach - start) / size - 0.5), F.lit(most - 1))

    def share(n: Column) -> Column:
        distance = F.abs(F.lit(start) + (n + 0.5) * size - middle) / reach
        return F.struct(n.alias("to"), (spline(distance) * (step / reach)).alias("weight"))

    return F.when(first <= last, F.transform(F.sequence(first, last), share))


def resample_spline(layer: Layer, target: Lattice) -> DataFrame:
    """layer, cell, row, col and value on another lattice: the weighted mean of the cells with data near each middle.

    Weights are a cubic B-spline of the distance along each axis. Gaps, NaN and
    what lies beyond the raster don't count, and the other weights make up for
    them; where all weights together come to less than LEAST_WEIGHT there is no
    row. Cells spread along their row and are added up, then along columns: two
    aggregates by place, no tile needs its neighbours.
    """
    own = layer.lattice
    held = layer.cells.where(F.col("value").isNotNull() & ~F.isnan("value"))
    along = reached(F.col("col").cast("long"), own.x, own.dx, target.x, target.dx, target.columns)
    spread = held.select("layer", "row", F.col("value").cast("double").alias("value"), F.explode(along).alias("s")).where("s.weight > 0")
    across = spread.groupBy("layer", "row", F.col("s.to").alias("col")).agg(F.sum(F.col("value") * F.col("s.weight")).alias("total"), F.sum("s.weight").alias("weight"))
    up = reached(F.lit(own.rows - 1) - F.col("row").cast("long"), own.y, own.dy, target.y, target.dy, target.rows)
    spread = across.select("layer", "col", "total", "weight", F.explode(up).alias("s")).where("s.weight > 0")
    share = F.col("s.weight")
    found = spread.groupBy("layer", F.col("s.to").alias("up"), "col").agg(F.sum(F.col("total") * share).alias("total"), F.sum(F.col("weight") * share).alias("weight")).where(F.col("weight") >= LEAST_WEIGHT)
    row = F.lit(target.rows - 1) - F.col("up")
    return found.select("layer", target.number(row, F.col("col")).alias("cell"), row.cast("int").alias("row"), F.col("col").cast("int").alias("col"), (F.col("total") / F.col("weight")).alias("value"))
