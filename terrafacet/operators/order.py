"""Numbers and running sums along an order, without one task for all rows.

Rows are dealt by ranges of the order and settled; each range counts within
itself and adds what the ranges before it hold, a row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafacet.session import settle


def running(df: DataFrame, value: Column, order: list[Column], name: str) -> DataFrame:
    """`df` with column `name`: the sum of `value` over the rows up to this one. Rows that tie in `order` stand in no certain order."""
    rows = settle(df.withColumn(name, value).repartitionByRange(*order).withColumn("range_", F.spark_partition_id()))
    inside = F.sum(name).over(Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    totals = rows.groupBy("range_").agg(F.sum(name).alias("total_"))
    before = totals.select("range_", (F.sum("total_").over(Window.orderBy("range_")) - F.col("total_")).alias("before_"))
    return rows.withColumn(name, inside).join(F.broadcast(before), "range_").withColumn(name, F.col(name) + F.col("before_")).drop("range_", "before_")


def numbered(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """`df` with its rows' numbers in an order, from 1."""
    return running(df, F.lit(1).cast("long"), order, name)
