"""Incremental collection as streams: files to documents, duplicates dropped by key, windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def new_rows(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """A stream of the Parquet files that arrive in ``folder``; its checkpoint is the memory of files seen."""
    return spark.readStream.schema(schema).parquet(folder)


def collect(stream: DataFrame, target: str, checkpoint: str, key: str = "doc_id") -> StreamingQuery:
    """Append rows whose key the target does not hold yet; ends when what is there has been read.

    A batch that is run again after a failure overwrites its own folder, so no row is written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy(key).agg(F.min(F.struct(*[F.col(c) for c in batch.columns if c != key])).alias("r")).select(key, "r.*")
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/batch=*"))
        others = [str(p.getPath()) for p in there or () if p.getPath().getName() != f"batch={number}"]
        if others:
            first = first.join(spark.read.parquet(*others).select(key), key, "left_anti")
        first.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, time: str, group: str, value: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows and sum of ``value`` by window and group, late rows up to ``late``."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    made = stream.withWatermark(time, late) if stream.isStreaming else stream
    return made.groupBy(window.alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), group, "n", "total")


def sessions(stream: DataFrame, time: str, group: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each group: rows no further apart than ``gap``."""
    made = stream.withWatermark(time, late) if stream.isStreaming else stream
    return made.groupBy(F.session_window(time, gap).alias("w"), group).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), group, "n")
