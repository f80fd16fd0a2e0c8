"""Samples of points with all that is known of them: field, layer name, value, pid and units, for each kind of layer.

Every function gives one row a row of points: pt, field, layername, value (text,
'' without one), pid and units, so that the fields of a request are a union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafacet.operators import polygons
from terrafacet.operators.rasters import Lattice, sample_classes

# What ids of analysis layers look like, in the order in which they are tried; folder, file and title of each, $1 and $2
# being the groups of the pattern.
ANALYSES = [
    (r"^species_(.*)$", "$1", "maxent/$1/$1", "Prediction"),
    (r"^aloc_(.*)$", "$1", "aloc/$1/aloc", "Classification"),
    (r"^odensity_(.*)$", "$1", "sitesbyspecies/$1/occurrence_density", "Occurrence Density"),
    (r"^srichness_(.*)$", "$1", "sitesbyspecies/$1/species_richness", "Species Richness"),
    (r"^([^_]*)_odensity$", "$1", "sitesbyspecies/$1/occurrence_density", "Occurrence Density"),
    (r"^([^_]*)_srichness$", "$1", "sitesbyspecies/$1/species_richness", "Species Richness"),
    (r"^envelope_(.*)$", "$1", "envelope/$1/envelope", "Environmental Envelope"),
    (r"^gdm_(.*)_([^_]*)$", "$2", "gdm/$2/$1", "Transformed $1"),
    (r"^([^_]*)_(.*)$", "$1", "gdm/$1/$2Tran", "Transformed $2"),
]


def _rows(found: DataFrame, field: str, layer: str, value: Column, pid: Column | None = None, units: str | None = None) -> DataFrame:
    return found.select("pt", F.lit(field).alias("field"), F.lit(layer).alias("layername"), F.coalesce(value, F.lit("")).alias("value"), (F.lit(None) if pid is None else pid).cast("string").alias("pid"), F.lit(units).cast("string").alias("units"))


def of_polygons(points: DataFrame, rings: DataFrame, names: DataFrame, field: str, layer: str) -> DataFrame:
    """The name (names: oid, name) and pid of the first object that holds a point."""
    hits = polygons.first_hit(points.select("pt", "x", "y"), rings).join(names.select("oid", "name"), "oid", "left")
    return _rows(hits, field, layer, F.col("name"), F.col("oid"))


def of_raster(points: DataFrame, cells: DataFrame, lattice: Lattice, field: str, layer: str, units: str) -> DataFrame:
    """The value of a point's cell, with its units."""
    placed = points.select("pt", lattice.key(F.col("x"), F.col("y"), F.col("pt")).alias("cell"))
    return _rows(placed.join(cells.select("cell", "value"), "cell", "left"), field, layer, F.col("value").cast("string"), None, units)


def of_classes(points: DataFrame, cells: DataFrame, names: DataFrame, lattice: Lattice, field: str, layer: str, layer_pid: str) -> DataFrame:
    """The class name of a point's cell; the pid is that of the layer with the class, where it has a name."""
    found = sample_classes(points, cells, names, lattice)
    return _rows(found, field, layer, F.col("class_name"), F.when(F.col("class_name") != "", F.concat_ws(":", F.lit(layer_pid), F.col("class").cast("string"))))


def analysis_layer(id_: Column) -> Column:
    """Struct gid, path and title of the analysis layer that an id names; null if it names none."""
    found = F.lit(None).cast("struct<gid:string,path:string,title:string>")
    for pattern, *parts in reversed(ANALYSES):
        gid, path, name = (F.regexp_replace(id_, pattern, part) for part in parts)
        if parts[2].startswith("Transformed"):
            name = F.concat(F.lit("Transformed "), F.replace(F.regexp_replace(id_, pattern, parts[2].split(" ")[1]), F.lit("Tran"), F.lit("")))
        found = F.when(id_.rlike(pattern), F.struct(gid.alias("gid"), path.alias("path"), name.alias("title"))).otherwise(found)
    return found
