"""Binary rasters with a text header: read as fixed-length records, one per raster row, so that files split.

A header holds sections and key=value lines; the body holds the cells from the
northern row on.
"""

from __future__ import annotations

import configparser
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafacet.operators.rasters import Lattice

# Data type names with their codes, and the default mark of no data.
TYPES = {"BYTE": "i1", "INT1BYTE": "i1", "UBYTE": "u1", "INT1UBYTE": "u1", "SHORT": "i2", "SMALLINT": "i2", "INT2BYTES": "i2", "INT": "i4", "INTEGER": "i4", "INT4BYTES": "i4", "LONG": "i8", "INT8BYTES": "i8", "FLOAT": "f4", "FLT4BYTES": "f4", "DOUBLE": "f8", "FLT8BYTES": "f8"}
NO_DATA = -3.4e38


@dataclass(frozen=True)
class Header:
    lattice: Lattice
    kind: str
    big: bool = False
    no_data: float = NO_DATA
    rescale: float = 1.0

    @property
    def dtype(self) -> np.dtype:
        return np.dtype((">" if self.big else "<") + TYPES[self.kind])


def rescale_of(units: str) -> float:
    """The factor that units begin with: '1/n ' or 'xn '; 1 without one."""
    word = units.split(" ")[0] if " " in units else ""
    try:
        return 1 / float(word[2:]) if word.startswith("1/") else float(word[1:]) if word.startswith("x") else 1.0
    except ValueError:
        return 1.0


def parse_header(text: str) -> Header:
    """The header of a raster; section and key names in any case."""
    reader = configparser.ConfigParser(strict=False, interpolation=None)
    reader.read_string(text)
    held = {k.lower(): v for section in reader.sections() for k, v in reader[section].items()}
    columns, rows = int(held["columns"]), int(held["rows"])
    x0, x9, y0, y9 = (float(held[k]) for k in ("minx", "maxx", "miny", "maxy"))
    lattice = Lattice(x0, y0, (x9 - x0) / columns, (y9 - y0) / rows, columns, rows)
    kind = held["datatype"].strip().upper()
    if kind not in TYPES:
        raise ValueError(f"unknown data type: {kind}")
    return Header(lattice, kind, held.get("byteorder", "LSB").strip().upper() in ("MSB", "M"), float(held.get("nodatavalue", NO_DATA)), rescale_of(held.get("units", "")))


def header_text(header: Header, low: float, high: float, units: str = "") -> str:
    """The text that parse_header reads; extents in full precision."""
    at = header.lattice
    lines = ["[General]", "Title=", "[GeoReference]", f"Columns={at.columns}", f"Rows={at.rows}", f"MinX={at.x!r}", f"MaxX={at.x + at.dx * at.columns!r}", f"MinY={at.y!r}", f"MaxY={at.y + at.dy * at.rows!r}", f"ResolutionX={at.dx!r}", f"ResolutionY={at.dy!r}"]
    lines += ["[Data]", f"DataType={header.kind}", f"MinValue={low!r}", f"MaxValue={high!r}", f"NoDataValue={header.no_data!r}", f"ByteOrder={'MSB' if header.big else 'LSB'}", f"Units={units}"]
    return "\n".join(lines) + "\n"


def read_grid(spark: SparkSession, path: str, layer: str) -> tuple[Header, DataFrame]:
    """The header `path`.grd, and cells (layer, cell, row, col, value FLOAT) of the body `path`.gri; no data is null."""
    header = parse_header("\n".join(r[0] for r in spark.read.text(f"{path}.grd", wholetext=True).collect()))  # a header's size
    columns, size = header.lattice.columns, header.lattice.columns * header.dtype.itemsize
    # Spark's own reader of fixed-length records; it has no DataFrame form
    records = spark.sparkContext.newAPIHadoopFile(
        f"{path}.gri",
        "org.apache.spark.input.FixedLengthBinaryInputFormat",
        "org.apache.hadoop.io.LongWritable",
        "org.apache.hadoop.io.BytesWritable",
        conf={"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(size)},
    )
    rows = spark.createDataFrame(records.mapValues(bytes), "row long, bytes binary")

    def decode(batches):
        for batch in batches:
            for row, raw in zip(batch.column("row").to_pylist(), batch.column("bytes").to_pylist()):
                value = np.frombuffer(raw, header.dtype)
                missing = np.isnan(value) | (value == np.array(header.no_data).astype(np.float32).astype(np.float64)) | (value == header.no_data)
                found = (value.astype(np.float64) * header.rescale).astype(np.float32)
                col = np.arange(columns, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(row * columns + col.astype(np.int64)), pa.array(np.full(columns, row, np.int32)), pa.array(col), pa.array(found, mask=missing)], names=["cell", "row", "col", "value"])

    return header, rows.mapInArrow(decode, "cell long, row int, col int, value float").select(F.lit(layer).alias("layer"), "cell", "row", "col", "value")


def encoded_rows(cells: DataFrame, header: Header) -> DataFrame:
    """row and bytes of every raster row, in the header's type and byte order; cells without a row or a value are no data."""
    at, dtype = header.lattice, header.dtype
    every = cells.sparkSession.range(at.rows).select(F.col("id").cast("int").alias("row"))
    held = cells.where("value is not null").groupBy("row").agg(F.collect_list(F.struct("col", "value")).alias("cells"))  # a raster row at most

    def encode(batches):
        for batch in batches:
            out = []
            for found in batch.column("cells").to_pylist():
                value = np.full(at.columns, header.no_data).astype(dtype)
                for c in found or []:
                    value[c["col"]] = c["value"] / header.rescale
                out.append(value.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.binary())], names=["row", "bytes"])

    return every.join(held, "row", "left").mapInArrow(encode, "row int, bytes binary")


def write_grid(cells: DataFrame, path: str, header: Header) -> None:
    """Write `path`.grd and `path`.gri, a local file: rows are encoded by tasks and pass the driver one partition at a time."""
    low, high = cells.agg(F.min("value"), F.max("value")).first()
    with open(f"{path}.grd", "w", encoding="utf-8") as file:
        file.write(header_text(header, low, high))
    with open(f"{path}.gri", "wb") as file:
        for row in encoded_rows(cells, header).orderBy("row").toLocalIterator():
            file.write(row.bytes)
