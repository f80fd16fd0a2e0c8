"""A cache of raster layers for point lookups: layers of one lattice interleaved, so that one record holds a cell's values of all of them.

A record is a little-endian 4-byte float a layer; records follow each other by
cell, some raster rows a file, so that a cell's file and offset follow from its
number. Tasks write the files, each under a name of its own first; `cache.json`
names them and is put in place last, so that readers see the cache before or
after a build and nothing between. A folder without it may hold groups of one file each:
group_N.txt (layer names, a line each), group_N.grd (header), group_N.gri (records).
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from terrafacet.operators.cutting import Layer
from terrafacet.operators.rasters import Lattice
from terrafacet.sources.grids import parse_header

# Fixed value: the mark of no data in records, the least float.
NO_DATA = np.finfo(np.float32).min
#: Bytes of one file, and of what one task of a scan reads.
FILE_BYTES, SCAN_BYTES = 64 << 20, 64 << 20
#: Rows of an Arrow batch of a scan, and the bytes between two records that are rather read than skipped.
SCAN_ROWS, GAP_BYTES = 8192, 4096


@dataclass(frozen=True)
class Group:
    """Layers of one lattice in the order of their values, their records' files (by raster row) and rows a file."""

    lattice: Lattice
    layers: tuple[str, ...]
    rows: int
    files: str  # path with {} for the file's number

    @property
    def size(self) -> int:
        """Bytes of a record."""
        return 4 * len(self.layers)

    @property
    def cells(self) -> int:
        return self.lattice.columns * self.lattice.rows


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def put(path: str, data: bytes) -> None:
    """Write a file as a whole: readers see it complete or as it was."""
    system, at = place(path)
    new = f"{at}.{uuid.uuid4().hex}"
    with system.open_output_stream(new, compression=None) as out:
        out.write(data)
    if not isinstance(system, fs.LocalFileSystem) and system.get_file_info(at).type != fs.FileType.NotFound:
        system.delete_file(at)  # a local move replaces the file
    system.move(new, at)


def content(path: str) -> str | None:
    """The text of a small file; None without it."""
    system, at = place(path)
    if system.get_file_info(at).type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(at, compression=None) as file:
        return file.read().decode("utf-8")


def groups_of(path: str) -> list[Group]:
    """The groups of a cache, from cache.json or else from the headers of single files; none in an empty folder."""
    path = path.rstrip("/")
    if (text := content(f"{path}/cache.json")) is not None:
        return [Group(Lattice(**g["lattice"]), tuple(g["layers"]), g["rows"], f"{path}/{g['files']}") for g in json.loads(text)["groups"]]
    found = []
    while (names := content(f"{path}/group_{len(found)}.txt")) is not None:
        header = parse_header(content(f"{path}/group_{len(found)}.grd"))
        layers = tuple(n for n in names.split("\n") if n)
        found.append(Group(header.lattice, layers, header.lattice.rows, f"{path}/group_{len(found)}.gri"))
    return found


def write_group(layers: list[Layer], lattice: Lattice, files: str, rows: int) -> None:
    """Write the records of layers of one lattice, `rows` raster rows a file.

    A task fills one file's records at a time, in memory. A cell without a value,
    or with NaN, is no data; of several values of a layer the greatest stays.
    Cells outside the lattice are an error.
    """
    many, columns, total = len(layers), lattice.columns, lattice.rows
    spark = layers[0].cells.sparkSession
    count = -(-total // rows)
    every = spark.range(count).select(F.col("id").alias("file"), F.lit(0).alias("k"), F.lit(None).cast("long").alias("cell"), F.lit(None).cast("float").alias("value"))
    for k, layer in enumerate(layers):
        held = layer.cells.where(F.col("value").isNotNull() & ~F.isnan("value"))
        every = every.unionByName(held.select(F.floor(F.col("cell") / (columns * rows)).alias("file"), F.lit(k).alias("k"), F.col("cell").cast("long").alias("cell"), F.col("value").cast("float").alias("value")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, records, done = None, None, []

        def finish() -> None:
            put(files.format(number), records.tobytes())
            done.append((number, records.nbytes))

        for batch in batches:
            file = batch.column("file").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(file)) + 1).tolist(), len(file)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if number is None or file[a] != number:
                    if number is not None:
                        finish()
                    number = int(file[a])
                    if not 0 <= number < count:
                        raise ValueError("a cell lies outside its lattice")
                    records = np.full(((min(rows, total - number * rows)) * columns, many), NO_DATA, "<f4")
                part = batch.slice(a, b - a)
                part = part.filter(part.column("cell").is_valid())
                # in ascending order of values: the last one stays
                records[part.column("cell").to_numpy() - number * rows * columns, part.column("k").to_numpy()] = part.column("value").to_numpy()
        if number is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.int64()) for k in (0, 1)], names=["file", "bytes"])

    dealt = every.repartition(min(count, 10_000), "file").sortWithinPartitions("file", "value")
    written = dealt.mapInArrow(write, "file long, bytes long").agg(F.count_distinct("file").alias("files")).first()
    if written["files"] != count:
        raise RuntimeError(f"{written['files']} of {count} files were written")


def build_cache(layers: dict[str, Layer], path: str, file_bytes: int = FILE_BYTES) -> list[Group]:
    """Write the cache of layers, by name, and return its groups: layers of the same lattice, in the order given.

    An earlier cache in the folder is replaced at the end; its files stay for who
    still reads them, until `drop_old`.
    """
    path = path.rstrip("/")
    alike: dict[Lattice, list[str]] = {}
    for name, layer in layers.items():
        alike.setdefault(layer.lattice, []).append(name)
    made = []
    build = f"build-{uuid.uuid4().hex}"
    system, at = place(path)
    for k, (lattice, names) in enumerate(alike.items()):
        rows = min(max(1, file_bytes // (lattice.columns * 4 * len(names))), lattice.rows)
        files = f"{build}/group_{k}-{{}}.gri"
        system.create_dir(f"{at}/{build}", recursive=True)
        write_group([layers[n] for n in names], lattice, f"{path}/{files}", rows)
        made.append({"lattice": asdict(lattice), "layers": names, "rows": rows, "files": files})
    system.create_dir(at, recursive=True)
    put(f"{path}/cache.json", json.dumps({"groups": made}).encode())
    return groups_of(path)


def drop_old(path: str) -> None:
    """Delete the files of builds that the cache no longer names, and of builds that failed."""
    system, at = place(path.rstrip("/"))
    named = {g.files.rsplit("/", 2)[1] for g in groups_of(path)}
    for info in system.get_file_info(fs.FileSelector(at)):
        if info.type == fs.FileType.Directory and info.base_name.startswith("build-") and info.base_name not in named:
            system.delete_dir(info.path)


def runs(cells: np.ndarray, gap: int) -> Iterator[tuple[int, int]]:
    """Places from and to of stretches of ascending cells whose neighbours differ by at most `gap` + 1."""
    cuts = [0, *(np.flatnonzero(np.diff(cells) > gap + 1) + 1).tolist(), len(cells)]
    return zip(cuts, cuts[1:]) if len(cells) else iter(())


def records_at(group: Group, cells: np.ndarray, gap_bytes: int = GAP_BYTES) -> tuple[np.ndarray, int]:
    """The values of ascending cells, a row each with NaN for no data, and the bytes read: their records, and short gaps between."""
    found, read = np.empty((len(cells), len(group.layers)), np.float32), 0
    each = group.rows * group.lattice.columns  # cells a file
    for number in np.unique(cells // each).tolist():
        start, end = np.searchsorted(cells, [number * each, (number + 1) * each])
        system, at = place(group.files.format(number))
        local = cells[start:end] - number * each
        with system.open_input_file(at) as file:
            for p, q in runs(local, gap_bytes // group.size):
                first, many = int(local[p]), int(local[q - 1] - local[p] + 1)
                raw = file.read_at(many * group.size, first * group.size)
                if len(raw) != many * group.size:
                    raise OSError(f"{at} is too short")
                read += len(raw)
                found[start + p : start + q] = np.frombuffer(raw, "<f4").reshape(many, -1)[local[p:q] - first]
    found[found == NO_DATA] = np.nan
    return found, read


def cells_of(lattice: Lattice, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """As Lattice.cell; -1 off the lattice and for NaN."""
    held = (x >= lattice.x) & (x <= lattice.x + lattice.dx * lattice.columns) & (y >= lattice.y) & (y <= lattice.y + lattice.dy * lattice.rows)
    col = np.floor((np.where(held, x, lattice.x) - lattice.x) / lattice.dx).astype(np.int64).clip(max=lattice.columns - 1)
    up = np.floor((np.where(held, y, lattice.y) - lattice.y) / lattice.dy).astype(np.int64).clip(max=lattice.rows - 1)
    return np.where(held, (lattice.rows - 1 - up) * lattice.columns + col, -1)


def sample_cache(points: DataFrame, path: str, read: Accumulator | None = None, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """Points (pt, x, y) with layer and value of each layer of the cache, a row for each row of points and layer.

    Off a layer's lattice, on no data and without a place the value is null. Each
    batch of points reads the records of its own cells, once each and all layers
    together; points aren't shuffled, so no place is too busy. For more points
    than cells a join with `read_cache` reads less. `read` is told the bytes read
    (more than once where tasks run again).
    """
    groups = groups_of(path)
    names = [n for g in groups for n in g.layers]
    schema = StructType([StructField("pt", points.schema["pt"].dataType)]).add("value", ArrayType(FloatType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("x", "y"))
            values = np.full((len(x), len(names)), np.nan, np.float32)
            start = 0
            for group in groups:
                cells = cells_of(group.lattice, x, y)
                on = np.flatnonzero(cells >= 0)
                asked, back = np.unique(cells[on], return_inverse=True)
                found, size = records_at(group, asked, gap_bytes)
                values[on, start : start + len(group.layers)] = found[back]
                start += len(group.layers)
                if read is not None:
                    read.add(size)
            flat = values.ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(names)), pa.array(flat, mask=np.isnan(flat)))
            yield pa.RecordBatch.from_arrays([batch.column("pt"), lists], names=["pt", "value"])

    if not names:
        return points.select("pt", F.lit("").alias("layer"), F.lit(0).cast("float").alias("value")).where(F.lit(False))
    wide = points.select("pt", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).mapInArrow(run, schema)
    return named(wide.select("pt", F.posexplode("value").alias("k", "value")), names).select("pt", "layer", "value")


def named(rows: DataFrame, names: list[str]) -> DataFrame:
    """`rows` with the layer of number k."""
    return rows.withColumn("layer", F.array(*map(F.lit, names))[F.col("k")])


@dataclass
class Cells(InputPartition):
    """A range of cells, the end left out."""

    first: int
    end: int


class GridCacheReader(DataSourceReader):
    """Reads the records of a range of cells of one group, and no others."""

    def __init__(self, group: Group, first: int, end: int):
        self.group, self.first, self.end = group, max(first, 0), min(end, group.cells)

    def partitions(self) -> list[Cells]:
        step = max(1, SCAN_BYTES // self.group.size)
        return [Cells(k, min(k + step, self.end)) for k in range(self.first, self.end, step)] or [Cells(0, 0)]

    def read(self, partition: Cells) -> Iterator[pa.RecordBatch]:
        for first in range(partition.first, partition.end, SCAN_ROWS):
            cells = np.arange(first, min(first + SCAN_ROWS, partition.end))
            values = records_at(self.group, cells)[0]
            flat = values.ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * values.shape[1]), pa.array(flat, mask=np.isnan(flat)))
            yield pa.RecordBatch.from_arrays([pa.array(cells), lists], names=["cell", "value"])


class GridCacheSource(DataSource):
    """spark.read.format("gridcache") with options path, group, and first and end of the cells: cell, and value of each layer."""

    @classmethod
    def name(cls) -> str:
        return "gridcache"

    def schema(self) -> str:
        return "cell long, value array<float>"

    def reader(self, schema: StructType) -> GridCacheReader:
        group = groups_of(self.options["path"])[int(self.options.get("group", 0))]
        return GridCacheReader(group, int(self.options.get("first", 0)), int(self.options.get("end", group.cells)))


def read_cache(spark: SparkSession, path: str, layers: list[str] | None = None, first: int = 0, end: int | None = None) -> DataFrame:
    """layer, cell, row, col and value of the cells with data, of some layers or all, from cell `first` to before `end` of their own lattices."""
    spark.dataSource.register(GridCacheSource)
    groups, found = groups_of(path), None
    if unknown := set(layers or []) - {n for g in groups for n in g.layers}:
        raise ValueError(f"no such layers in the cache: {sorted(unknown)}")
    for k, group in enumerate(groups):
        wanted = [n for n in group.layers if layers is None or n in layers]
        if not wanted:
            continue
        records = spark.read.format("gridcache").options(path=path, group=k, first=first, end=group.cells if end is None else end).load()
        one = named(records.select("cell", F.posexplode("value").alias("k", "value")).where("value is not null"), list(group.layers)).where(F.col("layer").isin(wanted))
        columns = group.lattice.columns
        one = one.select("layer", "cell", F.floor(F.col("cell") / columns).cast("int").alias("row"), F.pmod("cell", F.lit(columns)).cast("int").alias("col"), "value")
        found = one if found is None else found.unionByName(one)
    return spark.createDataFrame([], "layer string, cell long, row int, col int, value float") if found is None else found
