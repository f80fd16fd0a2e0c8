"""Session and table helpers shared by queries, tests and the bench."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("terrafacet")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data directory, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """`df` cut from its lineage in the shared checkpoint folder; an own folder where the setting is unset on one machine."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def _shared_folder(spark: SparkSession) -> str:
    """The folder below which Spark keeps this application's checkpoints."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir("file:///tmp/checkpoints")
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """As settle, by a Parquet table beside the checkpoints: computed once, its columns read as needed; deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that Python tasks can import it wherever they run."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    _SHIPPED.add(application)
    root = Path(__file__).parent
    packed = Path(tempfile.mkdtemp()) / "terrafacet.zip"
    with zipfile.ZipFile(packed, "w") as file:
        for source in sorted(root.rglob("*.py")):
            file.write(source, str(source.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(packed))


def working_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, deleted when the driver ends."""
    path = f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(at)
    system.deleteOnExit(at)
    return path
