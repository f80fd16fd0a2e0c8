"""Exact overlay of polygon layers.

Layers are dealt to common tiles, which halve where they are crowded; objects meet
in the tiles that both touch, each pair with the edges of that tile alone. What
they share there is a set of trapezoids, exact up to rounding, for holes,
overlapping parts and concave outlines alike. A pair has a row per tile, so that
neither large objects nor large results are one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafacet.functions import wkt
from terrafacet.operators import polygons, sweep, tiles

TRAPEZOIDS = "array<array<array<struct<x:double,y:double>>>>"


class Lists:
    """A list column of an Arrow batch: one flat array a field, and where each row's items lie."""

    def __init__(self, column: pa.Array):
        self.ends = column.offsets.to_numpy().astype(np.int64)
        items = column.values
        self.fields = [items.field(k).to_numpy(zero_copy_only=False) for k in range(items.type.num_fields)] if pa.types.is_struct(items.type) else [items.to_numpy(zero_copy_only=False)]

    def __getitem__(self, row: int) -> list[np.ndarray]:
        return [f[self.ends[row] : self.ends[row + 1]] for f in self.fields]


def walk_tile(objects: list[tuple[list[np.ndarray], np.ndarray]], tile: tuple[float, float, float, float]) -> sweep.Walk:
    """All slabs of a tile; an object is its edges (part, x1, y1, x2, y2) and the parts that hold the tile's corner."""
    edges, owner, part, corner_owner, corner_part, before = [], [], [], [], [], 0
    for who, (columns, inside) in enumerate(objects):
        names, number = np.unique(np.concatenate([columns[0], inside]), return_inverse=True)
        number = number + before
        before += len(names)
        edges.append(edge_rows(columns))
        part.append(number[: len(columns[0])])
        corner_part.append(number[len(columns[0]) :])
        owner.append(np.full(len(columns[0]), who))
        corner_owner.append(np.full(len(inside), who))
    cat = lambda arrays: np.concatenate(arrays).astype(np.int64)
    return sweep.walk(np.concatenate(edges), cat(owner), cat(part), (cat(corner_owner), cat(corner_part)), len(objects), tile)


def edge_rows(columns: list[np.ndarray]) -> np.ndarray:
    return np.stack(columns[1:5], axis=1).astype(np.float64).reshape(-1, 4)


def shared_in_tile(objects: list[tuple[list[np.ndarray], np.ndarray]], tile: tuple[float, float, float, float]) -> sweep.Trapezoids:
    """What objects share: all that is in any part of each of them."""
    found = walk_tile(objects, tile)
    return found.runs(np.logical_and.reduce([n > 0 for n in found.counts]))


def as_geometry(found: list[sweep.Trapezoids]) -> pa.Array:
    """An area a row: its trapezoids as polygons of one ring."""
    t = sweep.Trapezoids(*(np.concatenate([getattr(f, c) for f in found]) for c in ("x0", "x1", "low0", "low1", "high0", "high1")))
    x = np.stack([t.x0, t.x1, t.x1, t.x0, t.x0], axis=1).ravel()
    y = np.stack([t.low0, t.low1, t.high1, t.high0, t.low0], axis=1).ravel()
    n = len(t.x0)
    points = pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])
    rings = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 5), points)
    areas = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), rings)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(f.x0) for f in found)]).astype(np.int32)), areas)


def overlay(*layers: DataFrame, cell: float = polygons.CELL) -> DataFrame:
    """What objects of two or more layers of rings share: oid_a, oid_b, ..., level, kx, ky and geometry (trapezoids), a row per tile."""
    names = [f"oid_{chr(ord('a') + k)}" for k in range(len(layers))]
    schema = f"geometry {TRAPEZOIDS}"
    found = in_tiles(dict(zip(names, tiles.common_tiles(list(layers), cell))), cell, lambda rows: [as_geometry([shared_in_tile(objects, tile) for objects, tile in rows])], schema)
    return found.where(F.size("geometry") > 0)


def in_tiles(pieces: dict[str, tiles.Pieces], cell: float, f: Callable[[list[tuple]], list[pa.Array]], schema: str) -> DataFrame:
    """The oids of objects of layers (by column name) that meet in a tile, the tile, and what `f` makes of them.

    `f` takes, for each row, the objects (edges and parts at the corner) and the
    tile's box, and gives the columns of `schema`, a value a row.
    """
    met = None
    for name, one in pieces.items():
        rows = one.gathered().select(*tiles.TILE, F.col("oid").alias(name), F.col("edges").alias(f"edges_{name}"), F.col("inside").alias(f"inside_{name}"))
        met = rows if met is None else met.join(rows, list(tiles.TILE))
    kinds = {field.name: field.dataType.simpleString() for field in met.schema}
    names = list(pieces)
    kept = [*names, *tiles.TILE]
    added = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [(Lists(batch.column(f"edges_{n}")), Lists(batch.column(f"inside_{n}"))) for n in names]
            level, kx, ky = (batch.column(c).to_numpy() for c in tiles.TILE)
            width = cell / 2.0**level
            boxes = zip(kx * width, ky * width, (kx + 1) * width, (ky + 1) * width)
            rows = [([(edges[k], inside[k][0]) for edges, inside in sides], box) for k, box in enumerate(boxes)]
            if rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *f(rows)], names=[*kept, *added])

    return met.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + f", {schema}")


def overlay_areas(*layers: DataFrame) -> DataFrame:
    """oid_a, oid_b, ..., degrees2 and m2 of what layers share, by pair (or more) of objects."""
    geometry, names = F.col("geometry"), [f"oid_{chr(ord('a') + k)}" for k in range(len(layers))]
    sizes = overlay(*layers).select(*names, wkt.plane_area(geometry).alias("degrees2"), wkt.spherical_area(geometry).alias("m2"))
    return sizes.groupBy(*names).agg(F.sum("degrees2").alias("degrees2"), F.sum("m2").alias("m2"))


def rings_of(areas: DataFrame, oid: str = "oid", geometry: str = "geometry") -> DataFrame:
    """The ring vertices (oid, part, ring, i, x, y) of a table of areas."""
    parts = areas.select(F.col(oid).alias("oid"), F.posexplode(geometry).alias("part", "p"))
    rings = parts.select("oid", "part", F.posexplode("p").alias("ring", "r"))
    return rings.select("oid", "part", "ring", F.posexplode("r").alias("i", "v")).select("oid", "part", "ring", "i", "v.x", "v.y")


def areas_of(rings: DataFrame) -> DataFrame:
    """oid and geometry of a table of ring vertices."""
    vertices = F.array_sort(F.collect_list(F.struct("i", "x", "y")))
    ring = rings.groupBy("oid", "part", "ring").agg(F.transform(vertices, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("v"))
    part = ring.groupBy("oid", "part").agg(F.array_sort(F.collect_list(F.struct("ring", "v"))).alias("r"))
    part = part.select("oid", "part", F.transform("r", lambda x: x["v"]).alias("p"))
    return part.groupBy("oid").agg(F.array_sort(F.collect_list(F.struct("part", "p"))).alias("p")).select("oid", F.transform("p", lambda x: x["p"]).alias("geometry"))


def layer_in_area(layer: DataFrame, area: DataFrame) -> DataFrame:
    """oid, degrees2 and m2 of each object of a layer inside an area (rings of any number of objects that don't overlap)."""
    return overlay_areas(layer, area).groupBy(F.col("oid_a").alias("oid")).agg(F.sum("degrees2").alias("degrees2"), F.sum("m2").alias("m2"))


def relations(layer: DataFrame, area: DataFrame, cell: float = polygons.CELL) -> DataFrame:
    """oid_a, oid_b, intersects and within of the objects of two layers that have a point in common.

    A common edge or point is enough to intersect, which is decided exactly. An
    object is within another if they share an area and none of it, beyond rounding
    to sweep.GRID, is outside.
    """
    first, second = tiles.common_tiles([layer, area], cell)

    def pairs(rows: list[tuple]) -> list[pa.Array]:
        found = []
        for objects, tile in rows:
            walked = walk_tile(objects, tile)
            inside, other = (n > 0 for n in walked.counts)
            common, outside = (len(walked.runs(held).x0) > 0 for held in (inside & other, inside & ~other))
            met = common or bool(len(objects[0][0][0]) and len(objects[1][0][0]) and _touch(objects))
            found.append((met, common, outside))
        return [pa.array(c, pa.bool_()) for c in zip(*found)]

    def own(rows: list[tuple]) -> list[pa.Array]:
        return [pa.array([len((w := walk_tile(objects, tile)).runs(w.counts[0] > 0).x0) > 0 for objects, tile in rows], pa.bool_())]

    met = in_tiles({"oid_a": first, "oid_b": second}, cell, pairs, "met boolean, common boolean, outside boolean")
    found = met.groupBy("oid_a", "oid_b").agg(F.bool_or("met").alias("intersects"), F.bool_or("outside").alias("outside"), F.count_if("common").alias("tiles")).where("intersects")
    spread = in_tiles({"oid_a": first}, cell, own, "filled boolean").where("filled").groupBy("oid_a").agg(F.count("*").alias("all"))
    within = ~F.col("outside") & (F.col("tiles") > 0) & (F.col("tiles") == F.coalesce("all", F.lit(0)))
    return found.join(spread, "oid_a", "left").select("oid_a", "oid_b", "intersects", within.alias("within"))


def _touch(objects: list[tuple]) -> bool:
    """An edge of one object has a point in common with an edge of the other."""
    edges = [edge_rows(columns) for columns, _ in objects]
    a, b, _ = sweep.contacts(np.concatenate(edges))
    return bool(((a < len(edges[0])) != (b < len(edges[0]))).any())


def objects_intersecting(layer: DataFrame, area: DataFrame) -> DataFrame:
    """oid of the objects of a layer that have a point in common with any of another."""
    return relations(layer, area).select(F.col("oid_a").alias("oid")).distinct()


def objects_within(layer: DataFrame, area: DataFrame) -> DataFrame:
    """oid of the objects of a layer that lie within one of another."""
    return relations(layer, area).where("within").select(F.col("oid_a").alias("oid")).distinct()


def distributions_in(found: DataFrame, shapes: DataFrame, area: DataFrame) -> DataFrame:
    """Range maps (geom_idx, ...) with degrees2 and m2 of their shape (rings, oid) inside an area; those that share none are left out."""
    return found.join(layer_in_area(shapes, area).withColumnRenamed("oid", "geom_idx"), "geom_idx")


def clipped_tabulation(records: DataFrame, first: DataFrame, second: DataFrame, area: DataFrame) -> DataFrame:
    """pid1, pid2, degrees2, m2, occurrences and species of two layers inside an area; records (pt, x, y, species) are counted anew.

    Objects of the area may not overlap each other.
    """
    clipped = overlay_areas(first, second, area).groupBy(F.col("oid_a").alias("pid1"), F.col("oid_b").alias("pid2")).agg(F.sum("degrees2").alias("degrees2"), F.sum("m2").alias("m2"))
    within = polygons.contains(records, area).select("pt").distinct()
    inside = records.join(within, "pt", "left_semi")
    a, b = polygons.contains(inside, first), polygons.contains(inside, second)
    met = a.select("pt", F.col("oid").alias("pid1")).join(b.select("pt", F.col("oid").alias("pid2")), "pt")
    counted = met.join(inside.select("pt", "species"), "pt").groupBy("pid1", "pid2").agg(F.count("*").alias("occurrences"), F.count_distinct("species").alias("species"))
    return clipped.join(counted, ["pid1", "pid2"], "left").na.fill(0, ["occurrences", "species"])
