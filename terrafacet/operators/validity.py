"""Whether areas are valid: their text, their rings, and how these lie to each other.

A ring may not meet itself. Rings may share points but neither cross nor run along
each other; holes lie in the outline of their own part, beside each other, and
parts beside each other. That two holes may cut a part in two by their points
alone is not looked for. Rings are dealt to tiles, where meetings are found by a
sweep and decided exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafacet.functions import wkt
from terrafacet.operators import overlay, polygons, sweep, tiles


def ring_number(part: Column, ring: Column) -> Column:
    """One number for part and ring, from which Python gets both back."""
    return F.shiftleft(part.cast("long"), 32) + ring


def meets_badly(edges: np.ndarray, ring: np.ndarray) -> bool:
    """Edges of one ring meet elsewhere than at a common end, or fold back; or edges of two rings cross or run along each other."""
    a, b, along = sweep.contacts(edges)
    first, second = edges[a], edges[b]
    ways = [(first[:, 2:] - first[:, :2]), (second[:, 2:] - second[:, :2])]
    chained = [(first[:, 2:] == second[:, :2]).all(axis=1), (second[:, 2:] == first[:, :2]).all(axis=1)]
    same = ring[a] == ring[b]
    back = along & ((ways[0] * ways[1]).sum(axis=1) < 0)
    if (same & (~(chained[0] | chained[1]) | back)).any():
        return True
    # on one line: a common stretch, or but a point
    axis = (np.abs(ways[0][:, 0]) < np.abs(ways[0][:, 1])).astype(int)
    row = np.arange(len(a))
    span = [np.sort(np.stack([e[row, axis], e[row, axis + 2]], axis=1), axis=1) for e in (first, second)]
    stretch = np.minimum(span[0][:, 1], span[1][:, 1]) > np.maximum(span[0][:, 0], span[1][:, 0])
    turn = lambda p, q, r: sweep.orientation(p, q, r)
    through = (turn(first[:, :2], first[:, 2:], second[:, :2]) * turn(first[:, :2], first[:, 2:], second[:, 2:]) < 0) & (turn(second[:, :2], second[:, 2:], first[:, :2]) * turn(second[:, :2], second[:, 2:], first[:, 2:]) < 0)
    return bool((~same & ((along & stretch) | through)).any())


def nests_badly(ring: np.ndarray, edges: list[np.ndarray], inside: np.ndarray, tile: tuple[float, float, float, float]) -> bool:
    """Somewhere in the tile parts lie on each other, or holes of a part do, or a hole isn't in its own outline."""
    shell, shell_inside = ring & 0xFFFFFFFF == 0, inside & 0xFFFFFFFF == 0
    parts, times = np.unique(inside >> 32, return_counts=True)
    cut = lambda keep: [ring[keep], *(e[keep] for e in edges)]
    objects = [(cut(shell), inside[shell_inside]), (cut(~shell), inside[~shell_inside]), ([ring >> 32, *edges], parts[times % 2 == 1])]
    walked = overlay.walk_tile(objects, tile)
    shells, holes, left = walked.counts
    return len(walked.runs((left > 1) | (left != shells - holes)).x0) > 0


def badly_ringed(rings: DataFrame, cell: float = polygons.CELL) -> DataFrame:
    """oid of the objects of rings (oid, part, ring, i, x, y) whose rings meet or nest as those of areas don't."""
    named = rings.select("oid", ring_number(F.col("part"), F.col("ring")).alias("part"), F.lit(0).alias("ring"), "i", "x", "y")
    twice = tiles.edges_of(named).groupBy("oid", "part", "x1", "y1").agg(F.count("*").alias("n")).where("n > 1").select("oid")

    def bad(rows: list[tuple]) -> list[pa.Array]:
        found = []
        for [(columns, inside)], tile in rows:
            ring, edges = columns[0].astype(np.int64), [c.astype(np.float64) for c in columns[1:]]
            found.append(meets_badly(np.stack(edges, axis=1), ring) or nests_badly(ring, edges, inside.astype(np.int64), tile))
        return [pa.array(found, pa.bool_())]

    met = overlay.in_tiles({"oid": tiles.common_tiles([named], cell)[0]}, cell, bad, "bad boolean")
    return met.where("bad").select("oid").union(twice).distinct()


def valid_areas(texts: DataFrame) -> DataFrame:
    """oid and valid of each row of `texts` (oid, wkt; one row an oid): an area as a whole text, of rings as areas have them. A null text isn't valid."""
    read = texts.select("oid", wkt.wkt_valid(F.col("wkt")).alias("sound"), wkt.from_wkt(F.col("wkt")).alias("geometry"))
    bad = badly_ringed(overlay.rings_of(read.where("sound"))).withColumn("bad", F.lit(True))
    return read.select("oid", "sound").join(bad, "oid", "left").select("oid", (F.col("sound") & F.col("bad").isNull()).alias("valid"))
