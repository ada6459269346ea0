"""A session for work on one machine; on a cluster the caller's session is used as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """Adaptive execution on, UTC, and as many shuffle partitions as suit one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("sparkloom")
        .config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
