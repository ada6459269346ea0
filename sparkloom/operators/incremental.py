"""Sources seen before: state by key, what is new, and the state after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_entries(log: DataFrame, key: str = "key", order: str = "place") -> DataFrame:
    """The last entry of each key of a log."""
    rest = [c for c in log.columns if c not in (key, order)]
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_e")).select(key, *(F.col(f"_e.{c}").alias(c) for c in rest))


def unseen(sources: DataFrame, state: DataFrame) -> DataFrame:
    """Sources (key, hash) that the state doesn't hold with the same hash."""
    return sources.join(state.select("key", "hash").distinct(), ["key", "hash"], "left_anti")


def mark_seen(state: DataFrame, sources: DataFrame, order: str = "place") -> DataFrame:
    """The state after ``sources``, the last entry of a key winning."""
    old = state.withColumn(order, F.lit(-1).cast("long"))
    return last_entries(old.unionByName(sources.withColumn(order, F.col(order).cast("long")), allowMissingColumns=True), "key", order)


def run(sources: DataFrame, state: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New sources, the state after, and one row of counts (total, fresh, skipped). ``force`` forgets the state."""
    if force:
        state = state.limit(0)
    fresh = unseen(sources, state)
    counts = sources.agg(F.count(F.lit(1)).alias("total")).crossJoin(F.broadcast(fresh.agg(F.count(F.lit(1)).alias("fresh")))).select("total", "fresh", F.greatest(F.col("total") - F.col("fresh"), F.lit(0)).alias("skipped"))
    return fresh, mark_seen(state, fresh), counts
