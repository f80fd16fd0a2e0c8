"""Tables in the folder that driver and executors share, and Arrow batch helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of one Arrow batch that Python handles at a time; bounds a worker's memory.
BATCH_ROWS = 256
#: Rows of one Arrow batch between Spark and Python; bounds what both hold of long texts.
ARROW_ROWS = 1024
#: Ids of one broadcast of with_ids, and the number of broadcasts up to which it makes them.
BROADCAST_IDS, ID_PASSES = 2_000_000, 16


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset, an own folder if all runs on one machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file:///tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors. Deleted when the driver ends."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    at, fs = file_system(spark, path)
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def stored_and_counted(df: DataFrame, name: str, into: Callable[[DataFrame, str], DataFrame] = stored) -> tuple[DataFrame, int]:
    """As `stored`, with the number of rows, which are counted as they are written and not by a job of their own."""
    seen = Observation()
    table = into(df.observe(seen, F.count("*").alias("n")), name)
    return table, seen.get["n"]


def file_system(spark: SparkSession, path: str) -> tuple:
    """The path and its file system, as Spark sees them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Scratch:
    """Tables of one computation, deleted at the end of its `with` block; what leaves it must be stored elsewhere by then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.sent = spark, [], []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """As `stored`, for as long as the block lasts."""
        path = shared_path(self.spark, name)
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        """A folder for the parts of one table."""
        self.paths.append(shared_path(self.spark, name))
        return self.paths[-1]

    def part(self, df: DataFrame, folder: str, column: str, value: int) -> DataFrame:
        """As `stored`, as that part of the folder's table in which `column` has this value."""
        path = f"{folder}/{column}={value}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def parts(self, one: DataFrame, folder: str, column: str) -> DataFrame:
        """All parts of a folder's table by one scan, whose cost on the driver doesn't grow with their number; `one` of them has its other columns."""
        return self.spark.read.schema(StructType([*one.schema.fields]).add(column, "integer")).parquet(folder)

    def counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """As `stored`, with the number of rows."""
        return stored_and_counted(df, name, self.stored)

    def broadcast(self, value: object) -> Broadcast:
        """A broadcast for as long as the block lasts; what reads it must be stored by then."""
        self.sent.append(self.spark.sparkContext.broadcast(value))
        return self.sent[-1]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for sent in self.sent:
            sent.destroy()
        for path in self.paths:
            at, fs = file_system(self.spark, path)
            fs.delete(at, True)


def with_ids(docs: DataFrame, ids: DataFrame, most: int = BROADCAST_IDS, passes: int = ID_PASSES, how: str = "left_semi") -> DataFrame:
    """The rows of `docs` whose doc_id is among `ids`, without a shuffle of their texts; the others if `how` is left_anti.

    Ids go out in broadcasts of about `most`, each a range of them; the range is
    also asked of the scan of `docs`, so that a table in doc_id order is read
    about once. Above `passes` broadcasts rows and ids meet by a shuffle instead.
    """
    ids, number = stored_and_counted(ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "ids")
    parts = max(1, -(-number // most))
    if parts > passes:
        return docs.join(ids, "doc_id", how)
    cuts = ids.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 100_000)).first()[0] if parts > 1 else []
    found = None
    for low, high in zip([None, *cuts], [*cuts, None]):

        doc_id, mine = F.col("doc_id"), F.lit(True)
        if high is not None:
            mine &= doc_id <= high
        mine = mine | doc_id.isNull() if low is None else mine & (doc_id > low)
        part = docs.where(mine).join(F.broadcast(ids.where(mine)), "doc_id", how)  # about `most` ids
        found = part if found is None else found.unionByName(part)
    return found


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """Apply `f` to small Arrow batches. Spark sends ARROW_ROWS at a time, unless the session asks for another number than Spark's default."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            yield f(batch)

    return df.mapInArrow(run, schema)


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (and `more`) alone, so that other columns of whatever name do no harm."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
