"""Relational operators beyond Spark's own: as-of and range joins without a scan of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom import running


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, rows: int = 100_000) -> DataFrame:
    """``left`` with the latest ``value`` of ``right`` of the same key at or before its time; null if there is none.

    Both sides share one sorted pass, so no pair of rows is formed; a key of more than about ``rows`` rows is sorted in parts. At equal
    times the largest value counts. Rows of ``left`` without key or time have no value.
    """
    own = [c for c in left.columns]
    latest = right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(key, time).agg(F.max(value).alias("_v"))
    known = left.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    both = known.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1)).unionByName(latest.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    filled = running.carried(running.ranged(both, [key, time, "_side"], rows), [key], [time, "_side"], "_v")
    rest = left.where(F.col(key).isNull() | F.col(time).isNull()).withColumn(value, F.lit(None).cast(right.schema[value].dataType))
    return filled.where("_side = 1").withColumn(value, F.col("_v")).select(*own, value).unionByName(rest.select(*own, value))


def within_range(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: int) -> DataFrame:
    """Points (numbers) joined to the ranges [low, high) that hold them, through buckets of ``width``."""
    buckets = F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))
    spread = ranges.where(F.col(low) < F.col(high)).withColumn("_b", F.explode(buckets))
    return points.withColumn("_b", F.floor(F.col(point) / width)).join(spread, "_b").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_b")


def salted_sum(df: DataFrame, key: str, value: str, salts: int = 16) -> DataFrame:
    """Exact distinct count and sum by key, in two steps, so that a hot key is spread over ``salts`` tasks."""
    spread = df.groupBy(key, F.pmod(F.xxhash64(value), F.lit(salts)).alias("_s")).agg(F.countDistinct(value).alias("n"), F.sum(value).alias("t"))
    return spread.groupBy(key).agg(F.sum("n").alias("distinct_values"), F.sum("t").alias("total"))
