"""Rasters as polygons: the outlines of sets of cells, followed by joins.

The sides of a component's cells that it doesn't share with itself are its border,
directed so that the cells lie on the left. Straight runs of sides are drawn
together to corners. Rings are found by doubling the distance that each corner
looks ahead, so rounds grow with the logarithm of the longest ring, and no ring
and no component meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafacet.operators.rasters import Lattice
from terrafacet.session import settle

EAST, NORTH, WEST, SOUTH = range(4)


def border(cells: DataFrame) -> DataFrame:
    """component, x, y, d: the directed sides (place where it begins, direction) between a component's cells and others; y falls by one a row."""
    col, top = F.col("col"), -F.col("row")
    # of each side: direction, where it begins, and the lower left end of its line
    ends = [(EAST, col, top - 1, col, top - 1), (NORTH, col + 1, top - 1, col + 1, top - 1), (WEST, col + 1, top, col, top), (SOUTH, col, top, col, top - 1)]
    sides = F.array(*(F.struct(F.lit(d).alias("d"), x.alias("x"), y.alias("y"), F.lit(d % 2).alias("axis"), a.alias("a"), b.alias("b")) for d, x, y, a, b in ends))
    every = cells.select("component", "row", "col").distinct().select("component", F.explode(sides).alias("s"))
    once = every.groupBy("component", "s.axis", "s.a", "s.b").agg(F.count("*").alias("n"), F.first("s").alias("s"))  # two at most
    return once.where("n = 1").select("component", "s.x", "s.y", "s.d")


def corners(sides: DataFrame) -> DataFrame:
    """component, at and to: each corner (x, y, direction after it) with the next one. Where cells touch by a corner alone the border turns right."""
    ways = sides.groupBy("component", F.col("x").alias("ex"), F.col("y").alias("ey")).agg(F.collect_list("d").alias("ways"))  # two at most
    d = F.col("d")
    along = sides.withColumn("ex", F.col("x") + F.when(d == EAST, 1).when(d == WEST, -1).otherwise(0)).withColumn("ey", F.col("y") + F.when(d == NORTH, 1).when(d == SOUTH, -1).otherwise(0))
    after = F.when(F.size("ways") == 1, F.get("ways", 0)).otherwise((d + 3) % 4)
    met = along.join(ways, ["component", "ex", "ey"]).withColumn("after", after)
    place = F.when(d == EAST, F.col("x")).when(d == WEST, -F.col("x")).when(d == NORTH, F.col("y")).otherwise(-F.col("y"))
    met = met.withColumn("place", place).withColumn("line", F.when(d % 2 == 0, F.col("y")).otherwise(F.col("x")))
    run = Window.partitionBy("component", "d", "line").orderBy("place")  # a line of the lattice at most
    turns = F.when(F.col("after") != d, F.struct(F.col("ex").alias("x"), F.col("ey").alias("y"), F.col("after").alias("d")))
    begins = F.coalesce((F.lag("place").over(run) != F.col("place") - 1) | F.lag(turns).over(run).isNotNull(), F.lit(True))
    ends = F.first(turns, ignorenulls=True).over(run.rowsBetween(0, Window.unboundedFollowing))
    return met.select("component", F.struct("x", "y", "d").alias("at"), begins.alias("begins"), ends.alias("to")).where("begins").drop("begins")


def ringed(found: DataFrame) -> DataFrame:
    """Corners with `ring`, the least corner of their ring."""
    now = settle(found.select("component", "at", "to", F.col("to").alias("ahead"), F.col("at").alias("ring")))
    while True:
        far = now.select("component", F.col("at").alias("ahead"), F.col("ahead").alias("further"), F.col("ring").alias("seen"))
        low = F.least("ring", "seen")
        now = settle(now.join(far, ["component", "ahead"]).select("component", "at", "to", F.col("further").alias("ahead"), low.alias("ring"), (low != F.col("ring")).alias("changed")))
        # nobody saw a lesser corner twice as far ahead: each one has seen its whole ring
        if now.where("changed").isEmpty():
            return now.select("component", "at", "to", "ring")
        now = now.drop("changed")


def placed(found: DataFrame) -> DataFrame:
    """Corners with `left`, how many corners it takes to come to the ring's first one."""
    last = F.col("to") == F.col("ring")
    now = settle(found.select("component", "at", "to", "ring", F.when(~last, F.col("to")).alias("ahead"), F.lit(1).cast("long").alias("left")))
    while not now.where("ahead is not null").isEmpty():
        far = now.select("component", F.col("at").alias("ahead"), F.col("ahead").alias("further"), F.col("left").alias("more"))
        now = settle(now.join(far, ["component", "ahead"], "left").select("component", "at", "to", "ring", F.col("further").alias("ahead"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
    return now.drop("ahead")


def outlines(cells: DataFrame, lattice: Lattice) -> DataFrame:
    """Ring vertices (oid, part, ring, i, x, y) of the components of cells (component, row, col).

    oid is the component. Ring 0 is its outline, counterclockwise, for 4-connected
    components; the others are holes, clockwise. Only corners are vertices, and
    the last repeats the first. Rows without component, row or col are left out;
    a repeated cell counts once.
    """
    whole = cells.where("component is not null and row is not null and col is not null")
    found = placed(ringed(corners(border(whole))))
    turned = F.sum(F.col("at.x").cast("long") * F.col("to.y") - F.col("to.x").cast("long") * F.col("at.y"))
    rings = found.groupBy("component", F.col("ring").alias("first")).agg(turned.alias("turned"), F.count("*").alias("all"))
    number = F.row_number().over(Window.partitionBy("component").orderBy((F.col("turned") < 0).cast("int"), "first")) - 1
    rings = rings.select("component", "first", "all", number.alias("ring"))
    along = found.withColumnRenamed("ring", "first").join(rings, ["component", "first"])
    i = F.col("all") - F.col("left")
    # the first corner stands at both ends
    vertices = along.select("component", "ring", "at", F.explode(F.when(i == 0, F.array(i, F.col("all"))).otherwise(F.array(i))).alias("i"))
    x, y = F.lit(lattice.x) + F.col("at.x") * lattice.dx, F.lit(lattice.y) + (lattice.rows + F.col("at.y")) * lattice.dy
    return vertices.select(F.col("component").alias("oid"), F.lit(0).alias("part"), "ring", F.col("i").cast("int").alias("i"), x.alias("x"), y.alias("y"))
