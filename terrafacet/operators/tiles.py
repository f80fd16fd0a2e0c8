"""Polygon layers dealt to square tiles that halve where they are crowded.

A piece is what a tile needs of an object: the edges that touch the tile, and the
parts that hold the tile's lower left corner, from which the parity of every other
place of the tile follows by the edges between. So an object is never one row, and
a tile inside an object needs no edges. Tiles where an object has more than
PIECE_EDGES edges are cut into smaller ones, from the edges of the tile alone, round
by round.

Whether an edge runs below or beside a corner is decided by the sign of one
determinant, here and in the tasks that read the pieces, so that rounding can't
make the two disagree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafacet.session import written

#: Edges of an object in a tile, beyond which the tile is cut, and how often at most.
PIECE_EDGES, MOST_CUTS = 256, 6
#: A cut tile becomes 2 ** HALVINGS columns and rows of tiles.
HALVINGS = 2
#: The part of a tile's width by which places are taken to touch it though rounding says otherwise.
SLACK = 1e-9
EDGE = ("x1", "y1", "x2", "y2")
TILE = ("level", "kx", "ky")


def edges_of(rings: DataFrame) -> DataFrame:
    """oid, part and the edges x1, y1, x2, y2 of ring vertices (oid, part, ring, i, x, y) whose i has no gaps; a ring's last vertex repeats its first."""
    here = rings.select("oid", "part", "ring", "i", F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"))
    next_ = rings.select("oid", "part", "ring", (F.col("i") - 1).alias("i"), F.col("x").cast("double").alias("x2"), F.col("y").cast("double").alias("y2"))
    return here.join(next_, ["oid", "part", "ring", "i"]).where("x1 != x2 or y1 != y2").select("oid", "part", *EDGE)


def side(x1: Column, y1: Column, x2: Column, y2: Column, x: Column, y: Column) -> Column:
    """Positive where (x, y) lies left of the edge."""
    return (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)


def runs_below(x: Column, y: Column) -> Column:
    """The edge is over x, and below (x, y): a little to the right of x, and less above y."""
    x1, y1, x2, y2 = map(F.col, EDGE)
    at = side(x1, y1, x2, y2, x, y)
    steep = ((y2 > y1) == (x2 > x1)) & (y1 != y2)
    return ((x1 > x) != (x2 > x)) & F.when(at == 0, ~steep).otherwise((at > 0) == (x2 > x1))


def runs_right(x: Column, y: Column) -> Column:
    """The edge crosses the height y, to the right of (x, y)."""
    x1, y1, x2, y2 = map(F.col, EDGE)
    at = side(x1, y1, x2, y2, x, y)
    return ((y1 > y) != (y2 > y)) & (at != 0) & ((at > 0) == (y2 > y1))


def touching(edges: DataFrame, cell: float, columns: Column, rows: Column) -> DataFrame:
    """Edges with kx and ky of the tiles of a width that they touch, among some columns (array) and rows (array; may use kx)."""
    x1, y1, x2, y2, kx = (F.col(c) for c in (*EDGE, "kx"))
    slack = cell * SLACK
    dealt = edges.withColumn("kx", F.explode(columns)).where((kx * cell <= F.greatest(x1, x2) + slack) & ((kx + 1) * cell >= F.least(x1, x2) - slack))
    slope = F.when(x1 != x2, (y2 - y1) / (x2 - x1))
    inner = [F.least(F.greatest(F.least(x1, x2), (kx + k) * cell), F.greatest(x1, x2)) for k in (0, 1)]
    heights = [F.coalesce(y1 + (x - x1) * slope, y) for x, y in zip(inner, (y1, y2))]
    low = F.greatest(F.least(*heights), F.least(y1, y2)) - slack
    high = F.least(F.greatest(*heights), F.greatest(y1, y2)) + slack
    span = F.abs(y2 - y1) * SLACK
    dealt = dealt.withColumns({"low": low - span, "high": high + span})
    dealt = dealt.withColumn("ky", F.explode(rows))
    return dealt.where((F.col("ky") * cell <= F.col("high")) & ((F.col("ky") + 1) * cell >= F.col("low"))).drop("low", "high")


def whole(x: Column) -> Column:
    return F.floor(x).cast("long")


@dataclass
class Pieces:
    """edges: tile, oid, part, x1, y1, x2, y2. corners: tile, oid, part, for the parts that hold the tile's lower left corner. Level n has tiles of width cell / 2 ** n."""

    edges: DataFrame
    corners: DataFrame
    cell: float

    @classmethod
    def of(cls, rings: DataFrame, cell: float) -> Pieces:
        """Level 0."""
        edges = written(edges_of(rings))
        x1, y1, x2, y2 = map(F.col, EDGE)
        slack = cell * SLACK
        columns = F.sequence(whole((F.least(x1, x2) - slack) / cell), whole((F.greatest(x1, x2) + slack) / cell))
        rows = F.sequence(whole(F.col("low") / cell), whole(F.col("high") / cell))
        dealt = touching(edges, cell, columns, rows).withColumn("level", F.lit(0))
        return cls(dealt.select(*TILE, "oid", "part", *EDGE), cls._corners(edges, cell), cell)

    @staticmethod
    def _corners(edges: DataFrame, cell: float) -> DataFrame:
        """Each edge turns over the parity of all corners above it, in the columns that begin below it; between turns, corners are inside or not."""
        x1, y1, x2, y2 = map(F.col, EDGE)
        first, last = F.ceil(F.least(x1, x2) / cell).cast("long"), (F.ceil(F.greatest(x1, x2) / cell) - 1).cast("long")
        over = edges.where(first <= last).withColumn("kx", F.explode(F.sequence(first, last)))
        x = F.col("kx") * F.lit(cell)
        over = over.withColumn("k", whole((y1 + (x - x1) * ((y2 - y1) / (x2 - x1))) / cell))
        k = F.col("k")
        above = F.when(runs_below(x, (k - 1) * cell), k - 1).when(runs_below(x, k * cell), k).when(runs_below(x, (k + 1) * cell), k + 1).otherwise(k + 2)
        turns = over.where((x1 > x) != (x2 > x)).select("oid", "part", "kx", above.alias("ky")).groupBy("oid", "part", "kx", "ky").agg((F.count("*") % 2).alias("odd")).where("odd = 1")
        along = Window.partitionBy("oid", "part", "kx").orderBy("ky")  # the turns of one part over one line
        runs = turns.withColumn("n", F.row_number().over(along)).withColumn("past", F.lead("ky").over(along)).where("n % 2 = 1 and past is not null")
        return runs.select(F.lit(0).alias("level"), "kx", F.explode(F.sequence(F.col("ky"), F.col("past") - 1)).alias("ky"), "oid", "part")

    def width(self, level: int) -> float:
        return self.cell / (1 << level)

    def crowded(self) -> DataFrame:
        """The tiles in which an object has more than PIECE_EDGES edges."""
        return self.edges.groupBy(*TILE, "oid").agg(F.count("*").alias("n")).where(F.col("n") > PIECE_EDGES).select(*TILE).distinct()

    def within(self, tiles: DataFrame, how: str = "left_semi") -> Pieces:
        return Pieces(self.edges.join(tiles, list(TILE), how), self.corners.join(tiles, list(TILE), how), self.cell)

    def cut(self, level: int) -> Pieces:
        """All tiles, of one level, cut."""
        m, below = 1 << HALVINGS, level + HALVINGS
        small, wide = self.width(below), self.width(level)
        down = self.edges.select("oid", "part", *EDGE, F.col("kx").alias("px"), F.col("ky").alias("py"))
        new = [F.array(*(m * F.col(c) + k for k in range(m))) for c in ("px", "py")]
        edges = touching(down, small, *new).select(F.lit(below).alias("level"), "kx", "ky", "oid", "part", *EDGE)
        # from the tile's corner along its lower side to a new column, then up to a new corner: a row for each that the edge turns over
        x0, y0 = F.col("kx") * F.lit(wide), F.col("ky") * F.lit(wide)
        x1, y1, x2, y2 = map(F.col, EDGE)
        column = F.ceil(F.greatest(F.least(x1, x2) - x0, F.lit(0.0)) / small)
        matters = ((y1 > y0) != (y2 > y0)) | (x0 + column * small < F.greatest(x1, x2))
        every, k = F.explode(F.array(*map(F.lit, range(m * m)))).alias("k"), F.col("k")
        right, up = F.floor(k / m), k % m
        x = x0 + right * small
        turned = (runs_right(x0, y0) != runs_right(x, y0)) != (runs_below(x, y0 + up * small) != runs_below(x, y0))
        flips = self.edges.where(matters).select("kx", "ky", "oid", "part", *EDGE, every).where(turned).select("kx", "ky", "oid", "part", F.expr("shiftleft(1, k)").alias("bits"))
        inside = self.corners.select("kx", "ky", "oid", "part", F.lit((1 << m * m) - 1).alias("bits"))
        held = flips.unionByName(inside).groupBy("kx", "ky", "oid", "part").agg(F.bit_xor("bits").alias("bits"))
        corners = held.where("bits != 0").select("kx", "ky", "oid", "part", "bits", every).where(F.expr("(bits & shiftleft(1, k)) != 0"))
        corners = corners.select((m * F.col("kx") + right).alias("kx"), (m * F.col("ky") + up).alias("ky"), "oid", "part")
        return Pieces(edges, corners.select(F.lit(below).alias("level"), "kx", "ky", "oid", "part"), self.cell)

    def union(self, other: Pieces) -> Pieces:
        return Pieces(self.edges.unionByName(other.edges), self.corners.unionByName(other.corners), self.cell)

    def settled(self) -> Pieces:
        return Pieces(written(self.edges), written(self.corners), self.cell)

    def gathered(self) -> DataFrame:
        """tile, oid, edges (array of part and edge) and inside (array of parts): a row per object and tile, of about PIECE_EDGES edges."""
        edges = self.edges.groupBy(*TILE, "oid").agg(F.collect_list(F.struct("part", *EDGE)).alias("edges"))
        inside = self.corners.groupBy(*TILE, "oid").agg(F.collect_list("part").alias("inside"))
        found = edges.join(inside, [*TILE, "oid"], "full")
        return found.select(*TILE, "oid", *(F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in ("edges", "inside")))


def common_tiles(layers: list[DataFrame], cell: float) -> list[Pieces]:
    """Pieces of layers of rings on the same tiles, which are cut where any layer is crowded."""
    open_ = [Pieces.of(rings, cell) for rings in layers]
    done: list[Pieces] = []
    for n in range(MOST_CUTS + 1):
        heavy = open_[0].crowded()
        for pieces in open_[1:]:
            heavy = heavy.union(pieces.crowded())
        heavy = written(heavy.distinct())
        last = n == MOST_CUTS or heavy.isEmpty()
        calm = open_ if last else [pieces.within(heavy, "left_anti") for pieces in open_]
        done = [a.union(b) for a, b in zip(done, calm)] if done else calm
        if last:
            break
        open_ = [pieces.within(heavy).cut(n * HALVINGS).settled() for pieces in open_]
    return done
