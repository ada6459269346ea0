"""Running totals over a whole table without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.shared import table


def running_total(df: DataFrame, group: list[str], bucket: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` up to and including each row, by ``group`` in the order of ``order``.

    ``bucket`` must grow with ``order`` and split the rows evenly. Sums by bucket give each bucket its offset;
    only the rows of one bucket are sorted together, however large the group is.
    """
    rows = df.withColumn("_bucket", bucket)
    sums = rows.groupBy(*group, "_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    return rows.withColumn("_inside", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(offsets, [*group, "_bucket"]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_bucket", "_before", "_inside")


def ranged(df: DataFrame, order: list[str], rows: int = 100_000) -> DataFrame:
    """``df`` with ``_range``, which grows with ``order``: parts of about ``rows`` rows, one for tables that have no more."""
    count = df.count()
    if count <= rows:
        return df.withColumn("_range", F.lit(0))
    return table(df.repartitionByRange(-(-count // rows), *order).withColumn("_range", F.spark_partition_id()), "ranges")


def carried(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """``df`` (with ``_range``) whose nulls in ``value`` are filled by the last value before them in the group, through all its ranges."""
    last = df.groupBy(*group, "_range").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_last"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    brought = last.select(*group, "_range", F.last("_last", ignorenulls=True).over(before).alias("_brought"))
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(inside)).join(brought, [*group, "_range"]).withColumn(value, F.coalesce(value, "_brought")).drop("_brought", "_range")
