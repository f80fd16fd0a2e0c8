"""Tabulations: counts and areas for every pair of classes of two layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafacet.operators.rasters import Lattice


def classes_of(hits: DataFrame, name: str) -> DataFrame:
    """pt and each of its classes once, however often hits (pt, oid) repeat it; dealt by pt, as joins by pt ask."""
    return hits.groupBy("pt").agg(F.collect_set("oid").alias("all")).select("pt", F.explode("all").alias(name))


def species_pairs(records: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """pid1, pid2, occurrences and species of records (pt, species) by their classes (pt, oid) in two layers."""
    a, b = classes_of(first, "pid1"), classes_of(second, "pid2")
    return records.select("pt", "species").join(a, "pt").join(b, "pt").groupBy("pid1", "pid2").agg(F.count("*").alias("occurrences"), F.count_distinct("species").alias("species"))


def species_totals(records: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """As species_pairs, with the species of each row (speciest1) and column (speciest2), of records matched in both layers.

    One pass by grouping sets over distinct species, not three aggregates of the records.
    """
    a, b = classes_of(first, "pid1"), classes_of(second, "pid2")
    counted = records.select("pt", "species").join(a, "pt").join(b, "pt").groupBy("pid1", "pid2", "species").agg(F.count("*").alias("n"))
    sets = counted.groupingSets([["pid1", "pid2"], ["pid1"], ["pid2"]], "pid1", "pid2").agg(F.sum("n").alias("occurrences"), F.count_distinct("species").alias("species"), F.grouping_id().alias("g"))
    pairs, rows, columns = (sets.where(F.col("g") == g) for g in (0, 1, 2))
    with_rows = pairs.drop("g").join(rows.select("pid1", F.col("species").alias("speciest1")), "pid1")
    return with_rows.join(columns.select("pid2", F.col("species").alias("speciest2")), "pid2")


def raster_pair(a: DataFrame, b: DataFrame, lattice: Lattice) -> DataFrame:
    """value1, value2, area (km2) and cells of two rasters on one lattice, where both have data."""
    other = b.where("value is not null").select("cell", F.col("value").cast("int").alias("value2"))
    both = a.where("value is not null").select("cell", "row", F.col("value").cast("int").alias("value1")).join(other, "cell")
    return both.groupBy("value1", "value2").agg(F.sum(lattice.area(F.col("row"))).alias("area"), F.count("*").alias("cells"))


def raster_region(cells: DataFrame, mask: DataFrame, lattice: Lattice) -> DataFrame:
    """value and area (km2) of a raster's classes under a mask."""
    under = cells.where("value is not null").join(mask.select("cell"), "cell", "left_semi")
    return under.groupBy(F.col("value").cast("int").alias("value")).agg(F.sum(lattice.area(F.col("row"))).alias("area"))


def complete(tabulation: DataFrame, fields: DataFrame) -> DataFrame:
    """fid1, fid2 of the field pairs with area whose rows are all finished, between enabled fields."""
    unfinished = tabulation.where("area is null or occurrences is null").select("fid1", "fid2").distinct()
    usable = fields.where("enabled").select("id")
    sums = tabulation.groupBy("fid1", "fid2").agg(F.sum("area").alias("area")).where("area > 0").join(unfinished, ["fid1", "fid2"], "left_anti")
    for side in ("fid1", "fid2"):
        sums = sums.join(usable.withColumnRenamed("id", side), side, "left_semi")
    return sums.select("fid1", "fid2", "area")


def pairs_to_process(fields: DataFrame, layers: DataFrame, done: DataFrame) -> DataFrame:
    """fid1 < fid2 of analysed fields in layers of a common domain that aren't tabulated yet.

    A null domain goes with any; tokens of a domain compare without case. Fields are a catalogue, not data.
    """
    tokens = F.transform(F.split(F.lower("domain"), ","), F.trim)
    named = fields.where("analysis").join(layers.select(F.col("id").cast("string").alias("spid"), tokens.alias("domain")), "spid").select("id", "domain")
    a, b = (named.select(F.col("id").alias(f"fid{k}"), F.col("domain").alias(f"d{k}")) for k in (1, 2))
    same = F.col("d1").isNull() | F.col("d2").isNull() | F.arrays_overlap("d1", "d2")
    return a.join(b, (F.col("fid1") < F.col("fid2")) & same).select("fid1", "fid2").join(done, ["fid1", "fid2"], "left_anti")


def raster_pair_records(a: DataFrame, b: DataFrame, records: DataFrame, lattice: Lattice) -> DataFrame:
    """value1, value2, area (km2), occurrences and species of two rasters on one lattice and records (x, y, species); 0 where there are none."""
    other = b.where("value is not null").select("cell", F.col("value").cast("int").alias("value2"))
    both = a.where("value is not null").select("cell", "row", F.col("value").cast("int").alias("value1")).join(other, "cell")
    areas = both.groupBy("value1", "value2").agg(F.sum(lattice.area(F.col("row"))).alias("area"))
    placed = records.select(lattice.cell(F.col("x"), F.col("y")).alias("cell"), "species").where("cell is not null")
    found = placed.join(both.select("cell", "value1", "value2"), "cell").groupBy("value1", "value2").agg(F.count("*").alias("occurrences"), F.count_distinct("species").alias("species"))
    return areas.join(found, ["value1", "value2"], "left").na.fill(0, ["occurrences", "species"])


def named_tabulation(tabulation: DataFrame, objects: DataFrame) -> DataFrame:
    """A tabulation with name1 and name2 of its pids; of several names of a pid the least, null without one."""
    names = objects.groupBy("pid").agg(F.min("name").alias("name"))
    for k in (1, 2):
        tabulation = tabulation.join(names.select(F.col("pid").alias(f"pid{k}"), F.col("name").alias(f"name{k}")), f"pid{k}", "left")
    return tabulation


def distance_pairs(fields: DataFrame, layers: DataFrame, done: DataFrame) -> DataFrame:
    """fid1 < fid2 of the fields of environmental layers of a common domain whose distance isn't known yet."""
    usable = layers.where("type = 'Environmental'")
    return pairs_to_process(fields.withColumn("analysis", F.lit(True)), usable, done)
