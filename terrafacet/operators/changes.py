"""Changes of user objects (two tables), points of interest and tabulations, as changes of a store's version."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafacet.functions import wkt
from terrafacet.operators.catalog import delete_rows
from terrafacet.operators.order import numbered
from terrafacet.sources.store import Change, Snapshot

OBJECTS, OWNERS, POINTS, TABULATION = "objects", "uploaded_objects_metadata", "points_of_interest", "tabulation"


def measured(objects: DataFrame) -> DataFrame:
    """Objects with a column wkt, and area_km (of the sphere) and bbox (text) made from it; text that isn't an area is an error."""
    if not objects.where(F.col("wkt").isNull() | ~wkt.wkt_valid(F.col("wkt"))).isEmpty():
        raise ValueError("a text isn't an area")
    shape = objects.withColumn("shape_", wkt.from_wkt(F.col("wkt")))
    box = shape.withColumn("box_", wkt.box(F.col("shape_")))
    x0, y0, x9, y9 = (F.col(f"box_.{c}").cast("string") for c in ("x0", "y0", "x9", "y9"))
    corners = [F.concat_ws(" ", a, b) for a, b in ((x0, y0), (x0, y9), (x9, y9), (x9, y0), (x0, y0))]
    text = F.concat(F.lit("POLYGON(("), F.concat_ws(",", *corners), F.lit("))"))
    return box.withColumns({"area_km": wkt.spherical_area(F.col("shape_")) / 1e6, "bbox": text}).drop("shape_", "box_")


def highest(table: DataFrame, column: str) -> int:
    """The highest number in a column of numbers or their texts; 0 without one."""
    return table.agg(F.max(F.col(column).try_cast("long"))).first()[0] or 0


def one_each(rows: DataFrame, key: str) -> DataFrame:
    """`rows`, if no key is there twice or missing; an error otherwise."""
    if not rows.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).isEmpty():
        raise ValueError(f"{key} is there twice, or null")
    return rows


def create_objects(base: Snapshot, new: DataFrame, field: str, now: Column) -> Change:
    """Add user objects (wkt, name, desc, user_id, namesearch) to both tables under the pids and ids that follow the highest ones, in order of name, user and text."""
    objects, owners = base.read(OBJECTS), base.read(OWNERS)
    pid, id_ = highest(objects, "pid"), highest(owners, "id")
    rows = numbered(measured(new.select("wkt", "name", "desc", "user_id", "namesearch")), [F.col("name"), F.col("user_id"), F.col("wkt")])
    rows = rows.withColumns({"pid": (F.col("n") + pid).cast("string"), "id": F.col("n") + id_})
    made = rows.select("pid", F.col("id").cast("string").alias("id"), "name", "desc", F.lit(field).alias("fid"), "wkt", "namesearch", "bbox", "area_km")
    return Change(rows={OBJECTS: made, OWNERS: rows.select("pid", "id", "user_id", now.alias("time_last_updated"))})


def known(base: Snapshot, pids: DataFrame) -> DataFrame:
    """`pids`, if all are those of user objects; an error otherwise."""
    if not pids.join(base.read(OWNERS), "pid", "left_anti").isEmpty():
        raise ValueError("a pid isn't that of a user object")
    return pids


def updated(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with the other columns of `rows`, one a key, in place of its own; keys that it doesn't have add nothing."""
    columns = [c for c in rows.columns if c != key]
    new = rows.select(F.col(key), *(F.col(c).alias(f"new_{k}") for k, c in enumerate(columns)), F.lit(True).alias("new_"))
    both = table.join(new, key, "left")
    return both.select(*(F.when(F.col("new_"), F.col(f"new_{columns.index(c)}").cast(table.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns))


def update_objects(base: Snapshot, changed: DataFrame, now: Column) -> Change:
    """User objects (pid, wkt, name, desc, user_id) with new values, area and box, and the time of the change; a pid of no user object, or given twice, is an error."""
    rows = measured(one_each(known(base, changed.select("pid", "wkt", "name", "desc", "user_id")), "pid"))
    owners = rows.select("pid", "user_id", now.alias("time_last_updated"))
    return Change({OBJECTS: updated(base.read(OBJECTS), rows.drop("user_id"), "pid"), OWNERS: updated(base.read(OWNERS), owners, "pid")})


def delete_objects(base: Snapshot, pids: DataFrame) -> Change:
    """Both tables without user objects (pid); a pid of no user object is an error."""
    gone = known(base, pids.select("pid"))
    return Change({name: delete_rows(base.read(name), gone, ["pid"]) for name in (OBJECTS, OWNERS)})


def create_points(base: Snapshot, new: DataFrame) -> Change:
    """Add points of interest, of the table's columns but id, under the ids that follow the highest one, in order of all their columns."""
    points = base.read(POINTS)
    rest = [c for c in points.columns if c != "id"]
    rows = numbered(new.select(*rest), [F.col(c) for c in rest]).withColumn("id", F.col("n") + highest(points, "id"))
    return Change(rows={POINTS: rows.select(*points.columns)})


def update_points(base: Snapshot, changed: DataFrame) -> Change:
    """Points of interest (id and columns of the table) with new values; ids that aren't there add nothing."""
    return Change({POINTS: updated(base.read(POINTS), one_each(changed, "id"), "id")})


def delete_points(base: Snapshot, ids: DataFrame) -> Change:
    """Points of interest without some (id)."""
    return Change({POINTS: delete_rows(base.read(POINTS), ids.select("id"), ["id"])})


def save_tabulation(base: Snapshot, found: DataFrame, keys: tuple[str, ...] = ("fid1", "pid1", "fid2", "pid2")) -> Change:
    """Pairs of a tabulation with new numbers: a pair that is there takes the new values of the columns given, others are added; nulls are a key as well."""
    if TABULATION not in base.held:
        return Change({TABULATION: found})
    table = base.read(TABULATION)
    same = reduce(lambda a, b: a & b, (F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys))
    both = table.withColumn("in_", F.lit(True)).alias("old").join(found.withColumn("in_", F.lit(True)).alias("new"), same, "full")
    fresh = F.col("new.in_").isNotNull()
    columns = [F.when(fresh, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) if c in found.columns else F.col(f"old.{c}").alias(c) for c in table.columns]
    return Change({TABULATION: both.select(*columns)})
