"""Tables cut loose from their lineage, kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only inputs of at most so many bytes are spread by a shuffle; larger ones make enough tasks by their size.
SPREAD_BYTES = 1 << 30


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only on one machine (tests), where that is unset, is a local one made."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return qualified(spark, folder)


def qualified(spark: SparkSession, folder: str) -> str:
    """The address of a folder with the scheme of the file system that Spark writes it to, so that others read the same one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")
    return "file://" + found.removeprefix("file:") if found.startswith("file:/") and not found.startswith("file://") else found


def session_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_dir(spark)}/sparkloom/{spark.sparkContext.applicationId}"


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back: later reads share it, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, in order; none if it is not there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in system.listStatus(where)) if system.exists(where) else []


def mark(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if it was there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cleanup(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application. DataFrames that still read them fail afterwards."""
    remove(spark, session_dir(spark))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it is small and its files make fewer than half as many tasks, as one file does; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SPREAD_BYTES
    return df.repartition(cores) if small and 2 * df.rdd.getNumPartitions() < cores else df
