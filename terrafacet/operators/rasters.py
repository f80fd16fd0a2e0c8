"""Operators on rasters held as cell tables.

A raster is rows (layer, cell, row, col, value FLOAT) on a lattice given by a
Lattice; row 0 is the northern one; no data is a missing row or a null value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafacet.functions.measure import cell_area
from terrafacet.operators.tiles import edges_of
from terrafacet.session import settle


@dataclass(frozen=True)
class Lattice:
    """Lower left corner, cell sizes and numbers of columns and rows."""

    x: float
    y: float
    dx: float
    dy: float
    columns: int
    rows: int

    def cell(self, px: Column, py: Column) -> Column:
        """The cell (LONG) of a place, null outside; the upper edges belong to the last cells."""
        held = px.between(self.x, self.x + self.dx * self.columns) & py.between(self.y, self.y + self.dy * self.rows)
        col = F.least(F.lit(self.columns - 1), F.floor((px - self.x) / self.dx))
        up = F.least(F.lit(self.rows - 1), F.floor((py - self.y) / self.dy))
        return F.when(held, self.number(F.lit(self.rows - 1) - up, col))

    def number(self, row: Column, col: Column) -> Column:
        """The cell (LONG) of a row and a column."""
        return row.cast("long") * F.lit(self.columns).cast("long") + col.cast("long")

    def key(self, px: Column, py: Column, place: Column) -> Column:
        """As cell; places without one get a negative number by a hash of `place`, so that a join deals them out."""
        return F.coalesce(self.cell(px, py), -1 - F.pmod(F.xxhash64(place), F.lit(1 << 20)))

    def south(self, row: Column) -> Column:
        """Latitude of a row's southern edge."""
        return F.lit(self.y) + (self.rows - 1 - row) * self.dy

    def area(self, row: Column) -> Column:
        """Square kilometres of a cell of a row."""
        south = self.south(row)
        return cell_area(self.dy, F.when(south < 0, F.abs(south + self.dy)).otherwise(south))


def sample(points: DataFrame, cells: DataFrame, lattice: Lattice) -> DataFrame:
    """Points (pt, x, y) with layer and value of each layer, a row for each row of points; off the lattice or on no data the value is null."""
    layers = cells.select("layer").distinct()
    placed = points.select("pt", lattice.key(F.col("x"), F.col("y"), F.col("pt")).alias("cell"))
    by_cell = cells.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("layer", "value"))).alias("held"))  # an entry per layer
    met = placed.join(by_cell, "cell", "left").crossJoin(F.broadcast(layers))  # a row per layer
    return met.select("pt", "layer", F.expr("held[layer]").alias("value"))


def sample_classes(points: DataFrame, cells: DataFrame, names: DataFrame, lattice: Lattice) -> DataFrame:
    """pt, class and class_name ('' for a class without a name, null off the raster)."""
    placed = points.select("pt", lattice.key(F.col("x"), F.col("y"), F.col("pt")).alias("cell"))
    valued = placed.join(cells.select("cell", F.col("value").cast("int").alias("class")), "cell", "left")
    found = valued.join(names, "class", "left")
    return found.select("pt", "class", F.when(F.col("class").isNotNull(), F.coalesce("class_name", F.lit(""))).alias("class_name"))


def wide(long: DataFrame, layers: list[str], key: str = "pt") -> DataFrame:
    """One column per layer of a long table (key, layer, value)."""
    return long.groupBy(key).pivot("layer", layers).agg(F.first("value"))


def standardise(cells: DataFrame) -> DataFrame:
    """Values of each layer moved to 0 to 1; a layer of one value becomes null."""
    ends = cells.groupBy("layer").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return cells.join(F.broadcast(ends), "layer").select("layer", "cell", F.when(F.col("high") > F.col("low"), (F.col("value").cast("double") - F.col("low")) / (F.col("high").cast("double") - F.col("low"))).alias("value"))


def layer_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean absolute difference of two standardised rasters over the cells with data in both."""
    other = standardise(b).select("cell", F.col("value").alias("other"))
    return standardise(a).join(other, "cell").where("value is not null and other is not null").agg(F.avg(F.abs(F.col("value") - F.col("other"))).alias("distance"))


def class_stats(cells: DataFrame, lattice: Lattice) -> DataFrame:
    """class, area (km2), cells and box of rows and columns of each class."""
    valued = cells.where("value is not null").withColumn("class", F.col("value").cast("int"))
    boxes = [f(c).alias(f"{n}_{c}") for c in ("row", "col") for f, n in ((F.min, "min"), (F.max, "max"))]
    return valued.groupBy("class").agg(F.sum(lattice.area(F.col("row"))).alias("area"), F.count("*").alias("cells"), *boxes).where("area > 0")


def envelope(rasters: list[DataFrame], ranges: list[tuple[float, float]]) -> DataFrame:
    """The cells (cell, row, col) whose value lies in the range of every raster."""
    parts = [r.where(F.col("value").between(low, high)).select("cell", "row", "col") for r, (low, high) in zip(rasters, ranges)]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy("cell", "row", "col").agg(F.count("*").alias("n")).where(F.col("n") == len(parts)).drop("n")


def mask_extent(mask: DataFrame) -> DataFrame:
    """The box of a mask's rows and columns, both ends included."""
    return mask.agg(F.min("row").alias("top"), F.max("row").alias("bottom"), F.min("col").alias("left"), F.max("col").alias("right"), F.count("*").alias("cells"))


def cut(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """A raster's cells under a mask."""
    return cells.join(mask.select("cell"), "cell", "left_semi")


def coarsen(cells: DataFrame, n: int) -> DataFrame:
    """Of every n consecutive cells the last one's value."""
    return cells.groupBy("layer", F.floor(F.col("cell") / n).alias("run")).agg(F.max_by("value", "cell").alias("value"))


def merge_missing(source: DataFrame, other: DataFrame, fill: bool) -> DataFrame:
    """cell and value of `source` over the cells of either: gaps filled from `other`, or else made gaps where `other` has none."""
    both = source.select("cell", F.col("value").alias("a")).join(other.select("cell", F.col("value").alias("b")), "cell", "full")
    return both.select("cell", (F.coalesce("a", "b") if fill else F.when(F.col("b").isNotNull(), F.col("a"))).alias("value"))


def components(cells: DataFrame, same: str = "value") -> DataFrame:
    """cell, row, col, `same` and component: the least cell of the 4-connected cells of equal value.

    Labels move to neighbours and jump to their label's label, so rounds grow with
    the logarithm of the diameter of usual shapes; each round is checkpointed.
    """
    now = cells.select("cell", "row", "col", same).where(F.col(same).isNotNull()).withColumn("component", F.col("cell"))
    now = settle(now)
    steps = F.explode(F.array(*(F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in ((0, 1), (1, 0), (0, -1), (-1, 0)))))
    while True:
        sent = now.withColumn("d", steps).select((F.col("row") + F.col("d.dr")).alias("row"), (F.col("col") + F.col("d.dc")).alias("col"), same, F.col("component").alias("heard"))
        heard = sent.groupBy("row", "col", same).agg(F.min("heard").alias("heard"))
        moved = now.join(heard, ["row", "col", same], "left").select("cell", "row", "col", same, F.least("component", "heard").alias("to"), F.col("component").alias("was"))
        jump = moved.groupBy(F.col("was").alias("root")).agg(F.min("to").alias("lower"))
        after = settle(moved.join(jump, moved["to"] == jump["root"], "left").select("cell", "row", "col", same, F.least("to", "lower").alias("component"), (F.least("to", "lower") != F.col("was")).alias("changed")))
        if after.where("changed").isEmpty():
            return after.drop("changed")
        now = after.drop("changed")


def same_shape(headers: DataFrame) -> DataFrame:
    """Layers grouped by lattice: the number of the group and its layers, in order."""
    shape = ["x", "y", "dx", "dy", "columns", "rows"]
    grouped = headers.groupBy(*shape).agg(F.array_sort(F.collect_list("layer")).alias("layers"))
    return grouped.select(F.dense_rank().over(Window.orderBy(F.col("layers")[0])).alias("grid_group"), F.explode("layers").alias("layer"))


def filled(rings: DataFrame, lattice: Lattice) -> DataFrame:
    """oid, cell, row and col of the lattice cells whose middle lies in an object or on its border, once an object.

    By lines through the middles of rows: where edges of a part cross a line, the
    cells between the first crossing and the second, the third and the fourth, and
    so on, are inside. So the work grows with outlines and with what they hold,
    not with the lattice.
    """
    edges = edges_of(rings)
    x1, y1, x2, y2, up = (F.col(c) for c in ("x1", "y1", "x2", "y2", "up"))

    def line(y: Column) -> Column:
        """The row, counted from the south, whose middle is at y or next above it."""
        return F.ceil((y - lattice.y) / lattice.dy - 0.5)

    def middle(n: Column) -> Column:
        return F.lit(lattice.y) + (n + 0.5) * lattice.dy

    first, last = F.greatest(line(F.least(y1, y2)) - 1, F.lit(0)), F.least(line(F.greatest(y1, y2)) + 1, F.lit(lattice.rows - 1))
    met = edges.where(first <= last).withColumn("up", F.explode(F.sequence(first, last))).withColumn("y", middle(up))
    y = F.col("y")
    crossed = met.where((y1 > y) != (y2 > y)).select("oid", "part", "up", (x1 + (y - y1) * ((x2 - x1) / (y2 - y1))).alias("low"))
    along = Window.partitionBy("oid", "part", "up").orderBy("low")  # one part on one line
    between = crossed.withColumn("n", F.row_number().over(along)).withColumn("high", F.lead("low").over(along)).where("n % 2 = 1")
    # what lies on the line itself: level edges, and ends of others
    level = met.where((y1 == y) & (y2 == y)).select("oid", "up", F.least(x1, x2).alias("low"), F.greatest(x1, x2).alias("high"))
    ends = met.where(y1 == y).select("oid", "up", x1.alias("low"), x1.alias("high"))
    runs = between.select("oid", "up", "low", "high").unionByName(level).unionByName(ends)
    west, east = F.ceil((F.col("low") - lattice.x) / lattice.dx - 0.5), F.floor((F.col("high") - lattice.x) / lattice.dx - 0.5)
    west, east = F.greatest(west, F.lit(0)), F.least(east, F.lit(lattice.columns - 1))
    cells = runs.where(west <= east).select("oid", (F.lit(lattice.rows - 1) - up).cast("int").alias("row"), F.explode(F.sequence(west.cast("int"), east.cast("int"))).alias("col"))
    return cells.distinct().select("oid", lattice.number(F.col("row"), F.col("col")).alias("cell"), "row", "col")


def region_mask(rings: DataFrame, lattice: Lattice) -> DataFrame:
    """cell, row, col of the lattice cells whose middle is in any object."""
    return filled(rings, lattice).select("cell", "row", "col").distinct()


def rasterise(rings: DataFrame, lattice: Lattice) -> DataFrame:
    """cell, row, col and oid of the cells whose middle lies in an object; of several objects the least."""
    return filled(rings, lattice).groupBy("cell", "row", "col").agg(F.min("oid").alias("oid"))


def resample(cells: DataFrame, n: int) -> DataFrame:
    """layer, row, col and mean value of blocks of n by n cells, over the cells with data."""
    block = [F.floor(F.col(c) / n).cast("int").alias(c) for c in ("row", "col")]
    return cells.where("value is not null").groupBy("layer", *block).agg(F.avg(F.col("value").cast("double")).alias("value"))


def cell_states(rings: DataFrame, lattice: Lattice) -> DataFrame:
    """oid, cell, row, col and state of the lattice cells that an object covers in part or in full.

    'partial': an edge passes through the inside of the cell; 'full': none does and
    the cell lies in the object. An edge along the border of a cell doesn't pass
    through it. Other cells have no row.
    """
    edges = edges_of(rings)

    def crossed(low: Column, high: Column, start: float, step: float, most: int) -> Column:
        """The cells of one axis whose inside an interval meets."""
        first, last = F.greatest(F.floor((low - start) / step), F.lit(0)), F.least(F.ceil((high - start) / step) - 1, F.lit(most - 1))
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    by_col = edges.withColumn("col", crossed(F.least("x1", "x2"), F.greatest("x1", "x2"), lattice.x, lattice.dx, lattice.columns))
    west = F.lit(lattice.x) + F.col("col") * lattice.dx
    slope = F.when(F.col("x1") != F.col("x2"), (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")))
    inside = [F.coalesce(F.col("y1") + (x - F.col("x1")) * slope, F.col(y)) for x, y in ((F.greatest(F.least("x1", "x2"), west), "y1"), (F.least(F.greatest("x1", "x2"), west + lattice.dx), "y2"))]
    by_cell = by_col.select("oid", "col", crossed(F.least(*inside), F.greatest(*inside), lattice.y, lattice.dy, lattice.rows).alias("up"))
    partial = by_cell.distinct().select("oid", (F.lit(lattice.rows - 1) - F.col("up")).cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    partial = partial.withColumn("cell", lattice.number(F.col("row"), F.col("col")))

    full = filled(rings, lattice).join(partial.select("oid", "cell"), ["oid", "cell"], "left_anti")
    states = partial.withColumn("state", F.lit("partial")).unionByName(full.withColumn("state", F.lit("full")))
    return states.select("oid", "cell", "row", "col", "state")


def minmax(cells: DataFrame, rescale: float = 1.0) -> DataFrame:
    """layer, low and high of the cells with data, times a factor."""
    return cells.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("layer").agg((F.min("value") * F.lit(rescale).cast("float")).alias("low"), (F.max("value") * F.lit(rescale).cast("float")).alias("high"))


def translate(cells: DataFrame, values: DataFrame) -> DataFrame:
    """Cells with their value replaced where `values` (old, new) has another for it."""
    joined = cells.join(values.select(F.col("old").cast("float").alias("value"), F.col("new").cast("float").alias("new")), "value", "left")
    return joined.select("layer", "cell", F.coalesce("new", "value").alias("value"))


def merge_classes(names: DataFrame) -> DataFrame:
    """class, class_name and merged: one number, the least of its classes, for all classes of a name."""
    least = names.groupBy("class_name").agg(F.min("class").alias("merged"))
    return names.join(least, "class_name").select("class", "class_name", "merged")


def snap_extent(low: Column, high: Column, resolution: float) -> tuple[Column, Column]:
    """An interval shrunk to multiples of a resolution, at least two cells wide; ends that are multiples stay."""
    down = F.ceil(low / resolution) * resolution
    up = F.floor(high / resolution) * resolution
    return down, F.greatest(up, down + 2 * resolution)


def common_extent(boxes: DataFrame) -> DataFrame:
    """x0, y0, x9, y9 of what all boxes share; no row if they share no area."""
    shared = boxes.agg(F.max("x0").alias("x0"), F.max("y0").alias("y0"), F.min("x9").alias("x9"), F.min("y9").alias("y9"))
    return shared.where("x0 < x9 and y0 < y9")


def resolution_of(registry: DataFrame, wanted: float) -> DataFrame:
    """layer and the finest resolution that isn't finer than the wanted one, of a table (layer, resolution); a layer without one is left out."""
    return registry.where(F.col("resolution") >= wanted).groupBy("layer").agg(F.min("resolution").alias("resolution"))


def common_resolution(registry: DataFrame) -> DataFrame:
    """The finest resolution that every layer has, whatever its size."""
    layers = registry.agg(F.count_distinct("layer").alias("all"))
    held = registry.groupBy("resolution").agg(F.count_distinct("layer").alias("n"))
    return held.join(F.broadcast(layers), F.col("n") == F.col("all")).agg(F.min("resolution").alias("resolution"))  # one row


def row_starts(points: DataFrame, lattice: Lattice) -> DataFrame:
    """row, records and start: how many records lie in a raster row, and in the rows north of it."""
    counted = points.select(F.floor(lattice.cell(F.col("x"), F.col("y")) / lattice.columns).cast("int").alias("row")).where("row is not null").groupBy("row").agg(F.count("*").alias("records"))
    so_far = F.sum("records").over(Window.orderBy("row").rowsBetween(Window.unboundedPreceding, 0))  # a row per raster row
    return counted.withColumn("start", so_far - F.col("records"))
