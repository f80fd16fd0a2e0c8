"""Queries that change tables together and read them back, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafacet.functions import wkt
from terrafacet.operators import changes, overlay, polygons, tabulation
from terrafacet.plans.catalogue import BOTH, query
from terrafacet.session import working_folder
from terrafacet.sources.store import Change, Store


@query(
    "object plot diamond",
    """made AS (
      SELECT oid, name, cast((SELECT max(p_partkey) FROM object) + row_number() OVER (ORDER BY name) AS varchar) AS pid, row_number() OVER (ORDER BY name) AS number,
        min(x) AS x0, min(y) AS y0, max(x) AS x9, max(y) AS y9 FROM plot JOIN diamond USING (oid) GROUP BY oid, name),
    own AS (
      SELECT pid, CASE WHEN oid % 3 = 1 THEN name || ' 2' ELSE name END AS name, 'cl99' AS fid, CASE WHEN oid % 3 = 1 THEN 'later' ELSE 'user ' || oid % 4 END AS user_id, number AS owner,
        'POLYGON((' || x0 || ' ' || y0 || ',' || x0 || ' ' || y9 || ',' || x9 || ' ' || y9 || ',' || x9 || ' ' || y0 || ',' || x0 || ' ' || y0 || '))' AS bbox FROM made WHERE oid % 5 > 0)
    SELECT pid, name, fid, user_id, owner, bbox FROM own UNION ALL SELECT pid, name, fid, NULL, NULL, NULL FROM object""",
)
def user_objects_changed(objects, plot, diamond):
    spark, now = objects.sparkSession, F.lit("2020-01-02 03:04:05").cast("timestamp")
    store = Store(spark, working_folder(spark, "store"))
    held = objects.select("pid", F.col("pid").alias("id"), "name", F.col("description").alias("desc"), "fid", *(F.lit(None).cast(t).alias(c) for c, t in {"wkt": "string", "namesearch": "boolean", "bbox": "string", "area_km": "double"}.items()))
    owners = spark.createDataFrame([], "pid string, id long, user_id string, time_last_updated timestamp")
    store.commit(store.snapshot(), Change({changes.OBJECTS: held, changes.OWNERS: owners}))
    areas = overlay.areas_of(plot).select("oid", wkt.to_wkt(F.col("geometry")).alias("wkt")).join(diamond.select("oid", "name"), "oid")
    new = areas.select("oid", "wkt", "name", F.lit("a plot").alias("desc"), F.concat(F.lit("user "), F.col("oid") % 4).alias("user_id"), F.lit(False).alias("namesearch"))
    made = store.transact(lambda base: changes.create_objects(base, new, "cl99", now))
    pids = made.read(changes.OBJECTS).where("fid = 'cl99'").select("pid", "name").join(new.select("oid", "name", "wkt", "desc"), "name")
    later = pids.where("oid % 3 = 1").select("pid", "wkt", F.concat("name", F.lit(" 2")).alias("name"), "desc", F.lit("later").alias("user_id"))
    store.transact(lambda base: changes.update_objects(base, later, now))
    last = store.transact(lambda base: changes.delete_objects(base, pids.where("oid % 5 = 0")))
    both = last.read(changes.OBJECTS).join(last.read(changes.OWNERS).withColumnRenamed("id", "owner"), "pid", "left")
    return both.select("pid", "name", "fid", "user_id", "owner", "bbox")


@query(
    "occ ring box edge box_edge",
    BOTH
    + """, pairs AS (SELECT a.oid AS pid1, b.oid AS pid2, count(*) AS occurrences, count(DISTINCT species) AS species, count(*) FILTER (kind = 'purchase') AS bought, count(DISTINCT species) FILTER (kind = 'purchase') AS bought_species
      FROM occ JOIN a USING (pt) JOIN b USING (pt) GROUP BY ALL)
    SELECT 'cl1' AS fid1, cast(pid1 AS varchar) AS pid1, 'cl2' AS fid2, cast(pid2 AS varchar) AS pid2, CASE WHEN bought > 0 THEN bought ELSE occurrences END AS occurrences, CASE WHEN bought > 0 THEN bought_species ELSE species END AS species FROM pairs""",
)
def tabulation_saved(occ, ring, box, *_):
    spark = occ.sparkSession
    store = Store(spark, working_folder(spark, "store"))

    def pairs(records):
        found = tabulation.species_pairs(records, polygons.contains(records, ring), polygons.contains(records, box))
        return found.select(F.lit("cl1").alias("fid1"), F.col("pid1").cast("string").alias("pid1"), F.lit("cl2").alias("fid2"), F.col("pid2").cast("string").alias("pid2"), "occurrences", "species")

    store.transact(lambda base: changes.save_tabulation(base, pairs(occ)))
    return store.transact(lambda base: changes.save_tabulation(base, pairs(occ.where("kind = 'purchase'")))).read(changes.TABULATION)
