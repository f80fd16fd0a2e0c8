"""Shapefiles of polygons: many files are read side by side, each by one task and a record at a time.

The main file (.shp) holds rings, the table (.dbf) a row of text per record, in
the same order; the index (.shx) says where records lie, for other readers.
"""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafacet.functions import measure, wkt
from terrafacet.operators import overlay
from terrafacet.operators.order import numbered

# Fixed values of the format: the file's code and version, the kinds of record, and the text of a WGS84 projection file.
CODE, VERSION, NULL, POLYGONS = 9994, 1000, 0, (5, 15, 25)
WGS84 = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
NAME_BYTES = 254
VERTICES = pa.schema([("file", pa.string()), ("record", pa.int64()), ("part", pa.int32()), ("ring", pa.int32()), ("i", pa.int32()), ("x", pa.float64()), ("y", pa.float64())])


def turned(ring: np.ndarray) -> float:
    """Twice the signed area; clockwise is negative."""
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float(np.dot(x[:-1], y[1:]) - np.dot(x[1:], y[:-1]))


def holds(ring: np.ndarray, x: float, y: float) -> bool:
    a, b = ring[:-1], ring[1:]
    over = (a[:, 0] > x) != (b[:, 0] > x)
    a, b = a[over], b[over]
    return bool((a[:, 1] + (x - a[:, 0]) * (b[:, 1] - a[:, 1]) / (b[:, 0] - a[:, 0]) > y).sum() % 2)


def records_of(raw: bytes) -> Iterator[list[np.ndarray]]:
    """The rings of each record of a main file; a null record has none."""
    view, at = memoryview(raw), 100
    while at + 12 <= len(view):
        words, kind = struct.unpack_from(">i", view, at + 4)[0], struct.unpack_from("<i", view, at + 8)[0]
        if kind in POLYGONS:
            parts, places = struct.unpack_from("<2i", view, at + 44)
            starts = np.frombuffer(view, "<i4", parts, at + 52)
            yield np.split(np.frombuffer(view, "<f8", 2 * places, at + 52 + 4 * parts).reshape(-1, 2), starts[1:])
        elif kind == NULL:
            yield []
        else:
            raise ValueError(f"not a file of polygons: record of kind {kind}")
        at += 8 + 2 * words


def parts_of(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Outlines (clockwise) each with its holes: a hole goes to the last outline that holds its first vertex; one without is a part of its own."""
    parts = [[r] for r in rings if turned(r) <= 0]
    alone = []
    for hole in (r for r in rings if turned(r) > 0):
        home = next((p for p in reversed(parts) if holds(p[0], *hole[0])), None)
        alone.append([hole]) if home is None else home.append(hole)
    return parts + alone


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[A-Za-z]+$", 1)


def read_shapes(spark: SparkSession, paths: str) -> DataFrame:
    """file, record (from 0) and the ring vertices part, ring, i, x, y of the .shp files that a path or pattern names."""
    files = spark.read.format("binaryFile").load(paths).select(stem(F.col("path")).alias("file"), "content")

    def decode(batches):
        for batch in batches:
            for file, raw in zip(batch.column("file").to_pylist(), batch.column("content")):
                for record, rings in enumerate(records_of(raw.as_py())):
                    for part, members in enumerate(parts_of(rings)):
                        for ring, xy in enumerate(members):
                            n = len(xy)
                            fixed = [pa.array([v], t).take(pa.array(np.zeros(n, np.int64))) for v, t in ((file, pa.string()), (record, pa.int64()), (part, pa.int32()), (ring, pa.int32()))]
                            yield pa.RecordBatch.from_arrays([*fixed, pa.array(np.arange(n, dtype=np.int32)), pa.array(xy[:, 0]), pa.array(xy[:, 1])], schema=VERTICES)

    return files.mapInArrow(decode, "file string, record long, part int, ring int, i int, x double, y double")


def read_attributes(spark: SparkSession, paths: str, charset: str = "utf-8") -> DataFrame:
    """file, record (from 0) and attributes (a map of trimmed texts by column name) of the .dbf files that a path or pattern names; deleted rows have no map."""
    files = spark.read.format("binaryFile").load(paths).select(stem(F.col("path")).alias("file"), "content")

    def decode(batches):
        for batch in batches:
            for file, raw in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist()):
                count, head, size = struct.unpack_from("<IHH", raw, 4)
                fields, at = [], 1
                for k in range(32, head - 1, 32):
                    if raw[k] == 0x0D:
                        break
                    fields.append((raw[k : k + 11].split(b"\0")[0].decode("ascii", "replace"), at, raw[k + 16]))
                    at += raw[k + 16]
                for first in range(0, count, 1024):
                    numbers = list(range(first, min(count, first + 1024)))
                    rows = [raw[head + size * n : head + size * (n + 1)] for n in numbers]
                    held = [None if r[:1] == b"*" else [(name, r[a : a + n].decode(charset, "replace").strip(" \0")) for name, a, n in fields] for r in rows]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array(numbers, pa.int64()), pa.array(held, pa.map_(pa.string(), pa.string()))], names=["file", "record", "attributes"])

    return files.mapInArrow(decode, "file string, record long, attributes map<string,string>")


def feature_wkt(shapes: DataFrame, record: int, mercator: bool = False) -> DataFrame:
    """file and wkt of the record of a number in each file, from Web Mercator metres if asked."""
    one = shapes.where(F.col("record") == record).withColumn("oid", F.col("file"))
    if mercator:
        one = one.withColumns({"x": measure.longitude(F.col("x")), "y": measure.latitude(F.col("y"))})
    return overlay.areas_of(one).select(F.col("oid").alias("file"), wkt.to_wkt(F.col("geometry")).alias("wkt"))


def features(texts: DataFrame) -> DataFrame:
    """name and geometry of areas (name, wkt): a collection gives a feature for each member, its name followed by the member's number; what isn't an area is left out."""
    member = texts.select("name", F.size(wkt.collection_parts(F.col("wkt"))).alias("all"), F.posexplode(wkt.collection_parts(F.col("wkt"))).alias("k", "member"))
    name = F.when(F.col("all") > 1, F.concat_ws("_", F.col("name"), F.col("k").cast("string"))).otherwise(F.col("name"))
    return member.where(wkt.wkt_valid(F.col("member"))).select(name.alias("name"), wkt.from_wkt(F.col("member")).alias("geometry"))


def encoded(areas: DataFrame) -> DataFrame:
    """n (from 1), name and content of the record of every feature (name, geometry), numbered by name: outlines clockwise, holes counterclockwise."""
    ranked = numbered(areas.select("name", "geometry"), [F.col("name"), wkt.to_wkt(F.col("geometry"))])

    def encode(batches):
        for batch in batches:
            out = []
            for geometry in batch.column("geometry").to_pylist():
                rings = [(k == 0, np.array([(v["x"], v["y"]) for v in r], np.float64)) for part in geometry for k, r in enumerate(part)]
                rings = [xy[::-1] if (turned(xy) > 0) == outline else xy for outline, xy in rings]
                every = np.concatenate(rings)
                starts = np.cumsum([0, *(len(r) for r in rings[:-1])])
                box = [*every.min(axis=0), *every.max(axis=0)]
                out.append(struct.pack("<i4d2i", POLYGONS[0], *box, len(rings), len(every)) + starts.astype("<i4").tobytes() + every.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("n"), batch.column("name"), pa.array(out, pa.binary())], names=["n", "name", "content"])

    return ranked.select("n", "name", "geometry").mapInArrow(encode, "n long, name string, content binary")


def write_shapes(areas: DataFrame, path: str, zipped: bool = False) -> None:
    """Write features (name, geometry) as `path`.shp, .shx, .dbf and .prj, local files, and if asked as `path`.zip of them.

    Tasks encode the records; they pass the driver one partition at a time.
    """
    rows = encoded(areas)
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("content") + 8), F.lit(0))).first()
    box = areas.select(wkt.box(F.col("geometry")).alias("b")).agg(F.min("b.x0"), F.min("b.y0"), F.max("b.x9"), F.max("b.y9")).first()

    def head(length: int) -> bytes:
        return struct.pack(">i20xi", CODE, length // 2) + struct.pack("<2i4d32x", VERSION, POLYGONS[0], *(v or 0.0 for v in box))

    field = struct.pack("<11sc4xBB14x", b"name", b"C", NAME_BYTES, 0)
    with open(f"{path}.shp", "wb") as shp, open(f"{path}.shx", "wb") as shx, open(f"{path}.dbf", "wb") as dbf, open(f"{path}.prj", "w", encoding="ascii") as prj:
        prj.write(WGS84)
        shp.write(head(100 + size))
        shx.write(head(100 + 8 * count))
        dbf.write(struct.pack("<4BIHH20x", 3, 100, 1, 1, count, 65, NAME_BYTES + 1) + field + b"\r")
        at = 100
        for row in rows.orderBy("n").toLocalIterator():
            words = len(row.content) // 2
            shp.write(struct.pack(">2i", row.n, words) + row.content)
            shx.write(struct.pack(">2i", at // 2, words))
            text = (row.name or "").encode()[:NAME_BYTES].decode("utf-8", "ignore").encode()  # the format's longest text
            dbf.write(b" " + text.ljust(NAME_BYTES))
            at += 8 + len(row.content)
        dbf.write(b"\x1a")
    if zipped:
        with zipfile.ZipFile(f"{path}.zip", "w", zipfile.ZIP_DEFLATED) as out:
            for ending in ("shp", "shx", "dbf", "prj"):
                out.write(f"{path}.{ending}", f"{path.rsplit('/', 1)[-1]}.{ending}")


def unzip_shapes(path: str, folder: str) -> str:
    """Unpack the files of a zipped shapefile, without the folders they stand in, and return the main file's path."""
    found = None
    with zipfile.ZipFile(path) as packed:
        for member in packed.infolist():
            name = member.filename.rsplit("/", 1)[-1]
            if name and not name.startswith(".") and not member.is_dir():
                with packed.open(member) as source, open(f"{folder}/{name}", "wb") as target:
                    while piece := source.read(1 << 20):
                        target.write(piece)
                found = f"{folder}/{name}" if name.lower().endswith(".shp") else found
    if found is None:
        raise ValueError(f"no shapefile in {path}")
    return found
