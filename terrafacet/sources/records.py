"""Occurrence records and points from comma-separated lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafacet.operators import polygons

# The columns that the header names, in any order.
COLUMNS = {"species": "names_and_lsid", "x": "longitude", "y": "latitude", "year": "year"}


def parse_records(lines: DataFrame, header: str, value: str = "value") -> DataFrame:
    """species, x, y and year of lines of four parts; lines of other parts, or whose numbers don't read, are left out, as is the header."""
    place = {name.strip(): k for k, name in enumerate(header.split(","))}
    parts = F.split(F.col(value), ",")
    cell = {name: F.trim(F.get(parts, place[column])) for name, column in COLUMNS.items()}
    rows = lines.where((F.size(parts) == 4) & (F.col(value) != header)).select(
        *[c for c in lines.columns if c != value],
        cell["species"].alias("species"),
        cell["x"].try_cast("double").alias("x"),
        cell["y"].try_cast("double").alias("y"),
        cell["year"].try_cast("int").alias("year"),
    )
    return rows.where("x is not null and y is not null and year is not null")


def read_records(spark: SparkSession, path: str, rings: DataFrame | None = None) -> DataFrame:
    """The records of a file with a header line; with `rings`, those inside a layer."""
    lines = spark.read.text(path)
    rows = parse_records(lines, lines.first()[0])
    return rows if rings is None else within_region(rows, rings)


def within_region(records: DataFrame, rings: DataFrame) -> DataFrame:
    """The records inside any object of a layer; each distinct place is tested once."""
    places = records.select("x", "y").distinct().withColumn("pt", F.struct("x", "y"))
    held = polygons.contains(places, rings).select("pt.x", "pt.y").distinct()
    return records.join(held, ["x", "y"], "left_semi")


def species_index(records: DataFrame, order: str) -> DataFrame:
    """species and index: species numbered from 0 by where they first appear in an order."""
    from terrafacet.operators.order import numbered

    first = records.groupBy("species").agg(F.min(order).alias("first"))
    return numbered(first, [F.col("first"), F.col("species")], "index").select("species", (F.col("index") - 1).alias("index"))


def inline_points(lines: DataFrame, value: str = "value") -> DataFrame:
    """The other columns, i, x and y of texts "lat,lon,lat,lon,..."; a part that isn't a number is null, a last lone one is left out."""
    parts = F.split(F.col(value), ",")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), lambda k: F.struct(F.get(parts, 2 * k + 1).alias("x"), F.get(parts, 2 * k).alias("y")))
    rows = lines.where(F.size(parts) >= 2).select(*[c for c in lines.columns if c != value], F.posexplode(pairs).alias("i", "p"))
    return rows.select(*[c for c in rows.columns if c != "p"], F.trim("p.x").try_cast("double").alias("x"), F.trim("p.y").try_cast("double").alias("y"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """x and y of a file of lines "latitude,longitude" without a header."""
    return spark.read.csv(path, schema="y double, x double").select("x", "y")


def write_samples(samples: DataFrame, path: str, quote_all: bool = False) -> None:
    """A table with latitude and longitude first, as comma-separated files with a header; `quote_all` quotes every value and ends lines by CR LF."""
    ordered = samples.select("latitude", "longitude", *[c for c in samples.columns if c not in ("latitude", "longitude")])
    options = {"quoteAll": True, "lineSep": "\r\n"} if quote_all else {}
    ordered.write.options(header=True, emptyValue="", **options).csv(path)
