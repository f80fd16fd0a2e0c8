"""Queries on records, user data, names and tasks; with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafacet.operators import catalog, facets, tabulation
from terrafacet.plans.catalogue import AREA, CELL, LATTICE, hits_sql, query
from terrafacet.sources import records

HEADER = "year,names_and_lsid,latitude,longitude"
LINE = "concat_ws(',', cast(year as string), case when pt % 50 = 0 then 'a,b' else concat('sp ', cast(species as string)) end, case when pt % 31 = 0 then 'x' else cast(y as string) end, cast(x as string))"
READ = "pt % 50 <> 0 AND pt % 31 <> 0"


def lines_of(occ):
    return occ.select("pt", F.expr(LINE).alias("value"))


@query("occ", f"SELECT pt, 'sp ' || species AS species, x, y, year FROM occ WHERE {READ}")
def record_lines(occ):
    return records.parse_records(lines_of(occ), HEADER)


@query("occ ring edge", hits_sql("edge") + f" SELECT pt, 'sp ' || species AS species FROM occ WHERE {READ} AND pt IN (SELECT pt FROM hits)")
def record_lines_in_region(occ, ring, _):
    return records.within_region(records.parse_records(lines_of(occ), HEADER), ring).select("pt", "species")


@query("occ", "SELECT species, row_number() OVER (ORDER BY first) - 1 AS index FROM (SELECT species, min(pt) AS first FROM occ GROUP BY species)")
def species_index(occ):
    return records.species_index(occ, "pt")


@query("occ", "SELECT pt, k AS i, CASE WHEN k = 0 THEN x END AS x, y FROM occ, (VALUES (0), (1)) AS v(k)")
def inline_points(occ):
    text = F.concat_ws(",", F.col("y").cast("string"), F.col("x").cast("string"), F.col("y").cast("string"), F.lit("bad"))
    return records.inline_points(occ.select("pt", text.alias("value")))


@query("occ", "SELECT pt, CASE WHEN pt % 3 = 0 THEN NULL ELSE cast(trunc(amount) AS int) END AS whole, CASE WHEN pt % 3 = 0 THEN NULL ELSE amount END AS number FROM occ")
def typed_casts(occ):
    text = occ.select("pt", F.when(F.col("pt") % 3 == 0, "n/a").otherwise(F.col("amount").cast("string")).alias("t"))
    return text.select("pt", catalog.typed("t", "INT").alias("whole"), catalog.typed("t", "DOUBLE").alias("number"))


@query("raster", "SELECT cell FROM raster WHERE value BETWEEN 20000 AND 90000")
def layer_filter_range(raster):
    return raster.where(facets.layer_filters("ENVELOPE(el1,20000,90000:cl22,id1,id2)")[0].column()).select("cell")


@query("object", "SELECT pid FROM object WHERE fid IN ('cl3', 'cl7')")
def layer_filter_ids(objects):
    return objects.where(facets.layer_filters("ENVELOPE(cl22,cl3,cl7)")[0].column("fid")).select("pid")


@query("occ", "SELECT pt, kind, year FROM occ WHERE species BETWEEN 5 AND 20 AND kind = 'click' AND year >= 1990")
def chained_masks(occ):
    first = occ.where(facets.parse("species:[5 TO 20]").column()).select("pt")
    second = occ.where(facets.parse('kind:"click" AND year:[1990 TO *]').column()).join(first, "pt", "left_semi").select("pt")
    return catalog.masked(occ, second, ["pt", "kind", "year"])


@query("occ", "SELECT pt FROM occ WHERE (kind = 'click' OR kind = 'view') AND species >= 7")
def facet_text_round_trip(occ):
    facet = facets.parse("(kind:click OR kind:view) AND species:[7 TO *]")
    return occ.where(facets.parse(facets.text_of(facet)).column()).select("pt")


@query("classes raster2 occ", f"""placed AS (SELECT {CELL} AS cell, species FROM occ),
    pairs AS (SELECT a.cell, a.row, cast(a.value AS int) AS value1, cast(floor(b.value / 20000) AS int) AS value2 FROM classes a JOIN raster2 b USING (cell)),
    areas AS (SELECT value1, value2, sum({AREA}) AS area FROM pairs GROUP BY ALL),
    met AS (SELECT value1, value2, count(*) AS n, count(DISTINCT species) AS s FROM placed JOIN pairs USING (cell) GROUP BY ALL)
    SELECT value1, value2, round(area, 3) AS area, coalesce(n, 0) AS occurrences, coalesce(s, 0) AS species FROM areas LEFT JOIN met USING (value1, value2)""")
def tabulate_raster_records(classes, raster2, occ):
    banded = raster2.withColumn("value", F.floor(F.col("value") / 20_000))
    return tabulation.raster_pair_records(classes, banded, occ, LATTICE).withColumn("area", F.round("area", 3))


@query("object", "SELECT a.pid AS pid1, cast(a.partkey + 1 AS varchar) AS pid2, a.name AS name1, b.name AS name2 FROM (SELECT *, p_partkey AS partkey FROM object) a LEFT JOIN object b ON b.pid = cast(a.p_partkey + 1 AS varchar)")
def named_tabulation(objects):
    pairs = objects.select(F.col("pid").alias("pid1"), (F.col("p_partkey") + 1).cast("string").alias("pid2"))
    return tabulation.named_tabulation(pairs, objects).select("pid1", "pid2", "name1", "name2")


@query("field layer", """named AS (SELECT f.id, list_transform(string_split(lower(l.domain), ','), lambda d: trim(d)) AS d FROM field f JOIN layer l ON f.spid = cast(l.id AS varchar) WHERE l.type = 'Environmental')
    SELECT a.id AS fid1, b.id AS fid2 FROM named a JOIN named b ON a.id < b.id AND (a.d IS NULL OR b.d IS NULL OR list_has_any(a.d, b.d)) WHERE a.id <> 'cl0'""")
def distance_pairs(field, layer):
    other = field.select(F.lit("cl0").alias("fid1"), F.col("id").alias("fid2"))
    return tabulation.distance_pairs(field, layer, other)


@query("field layer", "SELECT 'el' || id AS id FROM layer WHERE id = 2 UNION ALL SELECT 'cl1001' AS id")
def new_field_ids(field, layer):
    return catalog.field_id(field, layer, 2).unionByName(catalog.field_id(field, layer, 1).select(F.when(F.col("id") == "cl1001", F.col("id")).alias("id")))


@query("field", "SELECT id, cast(substr(id, 3) AS int) AS number FROM field")
def layer_numbers(field):
    return field.select("id", catalog.layer_number(F.col("id")).alias("number"))


@query("object", "SELECT pid, CASE WHEN p_partkey % 2 = 0 THEN 'http://maps/layer/' || pid ELSE 'http://maps/x?' || pid END AS url FROM object")
def resolved_urls(objects):
    path = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("/layer/"), "pid")).otherwise(F.concat(F.lit("<BASE>/x?"), "pid"))
    return objects.select("pid", catalog.resolved_url(path, "http://maps", "<BASE>").alias("url"))


@query("object", "names AS (SELECT DISTINCT lower(name) AS name FROM object) SELECT o.pid, n.name, o.fid, cast(position('gi' IN n.name) AS int) AS place FROM names n JOIN object o ON lower(o.name) = n.name WHERE position('gi' IN n.name) > 0 ORDER BY place, n.name, pid LIMIT 15")
def names_then_objects(objects):
    names = objects.select(F.lower("name").alias("name")).distinct()
    return catalog.names_then_objects(names, objects, "GI", 15)


@query("object classname", "SELECT pid, name FROM (SELECT pid, name FROM object ORDER BY pid LIMIT 4) UNION ALL SELECT 'cl3:' || class, class_name FROM classname")
def search_with_classes(objects, names):
    rows = names.select(F.concat(F.lit("cl3:"), F.col("class").cast("string")).alias("pid"), F.col("class_name").alias("name"))
    return catalog.with_classes(objects.orderBy("pid").limit(4).select("pid", "name"), rows, 5)


@query("field", "SELECT name, row_number() OVER (ORDER BY n NULLS LAST, name) - 1 AS place FROM (SELECT CASE WHEN cast(substr(id, 3) AS int) % 2 = 0 THEN '__f' || substr(id, 3) ELSE id END AS name, CASE WHEN cast(substr(id, 3) AS int) % 2 = 0 THEN cast(substr(id, 3) AS int) END AS n FROM field)")
def numeric_order(field):
    name = F.when(F.substring("id", 3, 9).cast("int") % 2 == 0, F.concat(F.lit("__f"), F.substring("id", 3, 9))).otherwise(F.col("id"))
    return catalog.numeric_order(field.select(name.alias("name")))


@query("field", "SELECT id, name FROM field WHERE id <> 'cl5' UNION ALL SELECT 'cl5', 'new' UNION ALL SELECT 'cl99', 'more'")
def replaced_rows(field):
    rows = field.sparkSession.createDataFrame([("cl5", "new"), ("cl99", "more")], "id string, name string")
    return catalog.replace_rows(field.select("id", "name"), rows, ["id"])


@query("field", "SELECT id, name FROM field UNION ALL SELECT 'cl99', 'more'")
def inserted_absent(field):
    rows = field.sparkSession.createDataFrame([("cl5", "new"), ("cl99", "more"), ("cl99", "more")], "id string, name string")
    return catalog.insert_absent(field.select("id", "name"), rows, ["id"])


@query("field layer", "a AS (SELECT f.id, f.spid, l.name FROM field f JOIN layer l ON f.spid = cast(l.id AS varchar)) SELECT id AS key, id AS field FROM a UNION ALL SELECT name, min(id) FROM a GROUP BY name UNION ALL SELECT spid, min(id) FROM a GROUP BY spid")
def source_registry(field, layer):
    return catalog.registry(field.withColumn("defaultlayer", F.lit(False)), layer)


@query("occ", "SELECT pt AS id FROM occ WHERE pt % 3 <> 0 AND pt % 5 <= 2 ORDER BY ts, pt LIMIT 1")
def next_task(occ):
    tasks = occ.select(F.col("pt").alias("id"), (F.col("pt") % 5).alias("size"), F.col("ts").alias("created"), F.when(F.col("pt") % 3 == 0, F.col("ts")).alias("started"), F.lit(None).cast("timestamp").alias("finished"))
    return catalog.next_task(tasks, 2).select("id")
