"""Numbers over a whole table, in an order, without a task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add `name`: 1, 2, 3 ... in this order. Rows that agree in all of it may take their numbers either way round.

    Rows are dealt to ranges of the order, which are counted; a row's number is its place in its range and the rows of all
    ranges before it. The ranges are written once, as a sample decides where they begin. There are as many counts as
    ranges, which Spark's number of shuffle partitions bounds.
    """
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of the counts alone
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    out = ranged.withColumn("_place", place).join(F.broadcast(counts.select("_range", before.alias("_before"))), "_range")
    return out.withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")
