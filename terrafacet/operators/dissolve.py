"""Areas put together from trapezoids: inner sides cancel, what is left is stitched to rings.

The sides of all trapezoids of an object are directed so that the area lies on
their left. Upright sides between slabs, and level ones between tiles, are summed
up along their line: where as much lies on one side as on the other there is no
border. At every point a side that comes in goes on with the first one clockwise
that goes out, so rings that meet in a point stay apart. Rings are followed by the
doubling joins of `outlines`; no ring and no object meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafacet.operators import outlines, overlay, polygons
from terrafacet.session import written


def _point(x: Column, y: Column) -> Column:
    return F.struct((x + 0.0).alias("x"), (y + 0.0).alias("y"))  # no negative zero


def directed_sides(pieces: DataFrame) -> DataFrame:
    """component, a and b (points): the border of each component (column) with trapezoids (geometry, any number of rows)."""
    ring = pieces.select("component", F.explode("geometry").alias("p")).select("component", F.get("p", 0).alias("r"))
    corner = [F.get("r", k) for k in range(4)]  # lower left, lower right, upper right, upper left
    every = ring.select("component", *(_point(c["x"], c["y"]).alias(n) for c, n in zip(corner, ("ll", "lr", "ur", "ul"))))
    across = every.select("component", F.explode(F.array(F.struct(F.col("ll").alias("a"), F.col("lr").alias("b")), F.struct(F.col("ur").alias("a"), F.col("ul").alias("b")))).alias("s")).select("component", "s.*")
    level = across.where("a.y = b.y").select("component", F.lit(True).alias("level"), F.col("a.y").alias("line"), F.col("a.x").alias("from"), F.col("b.x").alias("to"))
    upright = F.array(F.struct(F.col("lr").alias("a"), F.col("ur").alias("b")), F.struct(F.col("ul").alias("a"), F.col("ll").alias("b")))
    down = every.select("component", F.explode(upright).alias("s")).where("s.a.y != s.b.y").select("component", F.lit(False).alias("level"), F.col("s.a.x").alias("line"), F.col("s.a.y").alias("from"), F.col("s.b.y").alias("to"))
    # a side adds its direction at its lower end and takes it away at its upper end
    sign = F.when(F.col("to") > F.col("from"), 1).otherwise(-1)
    ends = F.array(F.struct(F.least("from", "to").alias("at"), sign.alias("d")), F.struct(F.greatest("from", "to").alias("at"), (-sign).alias("d")))
    steps = level.unionByName(down).select("component", "level", "line", F.explode(ends).alias("e")).groupBy("component", "level", "line", "e.at").agg(F.sum("e.d").alias("d")).where("d != 0")
    along = Window.partitionBy("component", "level", "line").orderBy("at")  # one line of one component
    net = steps.withColumn("net", F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("past", F.lead("at").over(along)).where("net != 0")
    first, last = F.when(F.col("net") > 0, F.col("at")).otherwise(F.col("past")), F.when(F.col("net") > 0, F.col("past")).otherwise(F.col("at"))
    place = lambda v: F.when(F.col("level"), _point(v, F.col("line"))).otherwise(_point(F.col("line"), v))
    straight = net.select("component", place(first).alias("a"), place(last).alias("b"))
    return across.where("a.y != b.y").unionByName(straight)


def linked(sides: DataFrame) -> DataFrame:
    """component, at and to: each side (its points a, b) with the one that follows it."""
    at = F.struct("a", "b")
    turn = lambda one, other: F.atan2(other["y"] - one["y"], other["x"] - one["x"])
    a, b = F.col("a"), F.col("b")
    rays = F.array(
        F.struct(b.alias("p"), turn(b, a).alias("angle"), F.lit(0).alias("out"), at.alias("side")),
        F.struct(a.alias("p"), turn(a, b).alias("angle"), F.lit(1).alias("out"), at.alias("side")),
    )
    met = sides.select("component", F.explode(rays).alias("r")).select("component", "r.*")
    clockwise = Window.partitionBy("component", "p").orderBy(F.desc("angle"), "out")  # the sides at one point
    following = F.coalesce(F.lead("side").over(clockwise), F.first("side").over(clockwise.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return met.select("component", "out", F.col("side").alias("at"), following.alias("to")).where("out = 0").drop("out")


def dissolved(pieces: DataFrame) -> DataFrame:
    """Ring vertices (component, part, ring, i, x, y) of the areas of components (component, geometry: trapezoids).

    Ring 0 of a part is its outline, counterclockwise; its holes follow, clockwise.
    The last vertex repeats the first. Vertices may stand on straight lines, where
    slabs and tiles met. Components without a component name are left out.
    """
    sides = written(directed_sides(pieces.where("component is not null")))
    found = written(outlines.placed(outlines.ringed(linked(sides))))
    x, y, ex, ey = (F.col(c) for c in ("at.a.x", "at.a.y", "at.b.x", "at.b.y"))
    rings = written(found.groupBy("component", F.col("ring").alias("first")).agg(F.sum(x * ey - ex * y).alias("turned"), F.count("*").alias("all")))
    outer = rings.where("turned > 0")
    number = F.row_number().over(Window.partitionBy("component").orderBy("first")) - 1
    outer = written(outer.select("component", "first", "turned", "all", number.alias("part")))
    # a hole belongs to the smallest outline around the middle of one of its sides
    of = rings.where("turned <= 0").select("component", "first", "all")
    hole = of.select(F.struct("component", "first").alias("pt"), ((F.col("first.a.x") + F.col("first.b.x")) / 2).alias("x"), ((F.col("first.a.y") + F.col("first.b.y")) / 2).alias("y"))
    around = _vertices(found, outer.select("component", "first", "all", "part", F.lit(0).alias("ring"))).select(F.struct("component", "part").alias("oid"), F.lit(0).alias("part"), "ring", "i", "x", "y")
    held = polygons.contains(hole, around).where("pt.component = oid.component").select(F.col("pt.component").alias("component"), F.col("pt.first").alias("first"), F.col("oid.part").alias("part"))
    held = held.join(outer.select("component", "part", "turned"), ["component", "part"]).groupBy("component", "first").agg(F.min(F.struct("turned", "part")).alias("m"))
    holes = of.join(held, ["component", "first"], "left").withColumn("part", F.coalesce("m.part", F.lit(0)))
    ring = F.row_number().over(Window.partitionBy("component", "part").orderBy("first"))
    named = outer.select("component", "first", "all", "part", F.lit(0).alias("ring")).unionByName(holes.select("component", "first", "all", "part", ring.alias("ring")))
    return _vertices(found, named)


def _vertices(found: DataFrame, rings: DataFrame) -> DataFrame:
    along = found.withColumnRenamed("ring", "first").join(rings, ["component", "first"])
    i, last = (F.col("all") - F.col("left")).cast("int"), F.col("all").cast("int")
    # the first vertex stands at both ends
    return along.select("component", "part", "ring", F.explode(F.when(i == 0, F.array(i, last)).otherwise(F.array(i))).alias("i"), F.col("at.a.x").alias("x"), F.col("at.a.y").alias("y"))


def dissolved_overlay(first: DataFrame, second: DataFrame) -> DataFrame:
    """Ring vertices (oid_a, oid_b, part, ring, i, x, y) of what each pair of objects of two layers shares."""
    pieces = overlay.overlay(first, second).select(F.struct("oid_a", "oid_b").alias("component"), "geometry")
    return dissolved(pieces).select("component.*", "part", "ring", "i", "x", "y")
