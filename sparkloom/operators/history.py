"""Run history and prompt cache as tables: snapshots in, snapshots out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text


def recent(runs: DataFrame, count: int, time: str = "started_at", key: str = "id") -> DataFrame:
    """The newest ``count`` rows; ties go to the larger key."""
    return runs.orderBy(F.desc_nulls_last(time), F.desc(key)).limit(count)


def run_statistics(runs: DataFrame) -> DataFrame:
    """One row: runs by status and means of what was measured."""
    is_ = lambda s: F.count_if(F.lower(F.col("status")) == s)
    return runs.agg(F.count(F.lit(1)).alias("runs"), is_("completed").alias("completed"), is_("failed").alias("failed"), is_("running").alias("running"), text.rounded(F.avg("avg_score"), 3).alias("avg_score"), text.rounded(F.avg("pass_rate"), 3).alias("pass_rate"), text.rounded(F.avg("weighted_eval"), 3).alias("weighted_eval"))


def append(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """``table`` with new rows, whose keys follow the largest one in the order of ``place``. New batches are small."""
    last = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("last"))
    fresh = rows.crossJoin(F.broadcast(last)).withColumn(key, F.col("last") + F.row_number().over(Window.orderBy("place"))).drop("last", "place")
    return table.unionByName(fresh, allowMissingColumns=True)


#: What the end of a run sets where nothing else is given; all other fields become null.
FINISHED = {"status": "completed", "iterations": 0, "results_path": "", "eval_path": "", "suggestions_path": "", "notes": ""}
FINISH_FIELDS = ["status", "iterations", "avg_score", "pass_rate", "weighted_eval", "corpus_chars", "n_suggestions", "results_path", "eval_path", "suggestions_path", "notes"]


def finish(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``table`` whose key is in ``changes`` with every field of a finished run set anew: to the value given, else to its default.

    Fields that ``table`` lacks don't matter, unknown keys change nothing. A key must occur once in ``changes``.
    """
    value = lambda c: F.coalesce(F.col(f"_{c}"), F.lit(FINISHED.get(c))) if c in changes.columns else F.lit(FINISHED.get(c))
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in changes.columns if c != key), F.lit(True).alias("_hit"))
    types = {f.name: f.dataType for f in table.schema}
    set_ = lambda c: F.when(F.col("_hit"), value(c).cast(types[c])).otherwise(F.col(c)).alias(c)
    return table.join(new, key, "left").select(*(set_(c) if c in FINISH_FIELDS else F.col(c) for c in table.columns))


def upsert(cache: DataFrame, entries: DataFrame, keys: list[str], order: str, value: str, hits: str = "hits") -> DataFrame:
    """One row of each key: the latest value, and the hits known before, which a new value keeps. ``order`` must not tie within a key."""
    rows = cache.select(*keys, order, value, hits, F.lit(0).alias("_new")).unionByName(entries.select(*keys, order, value, F.lit(None).cast("long").alias(hits), F.lit(1).alias("_new")))
    latest = F.max_by(F.struct(order, value), F.struct("_new", order))
    return rows.groupBy(*keys).agg(latest.alias("_l"), F.coalesce(F.max(hits), F.lit(0)).alias(hits)).select(*keys, F.col(f"_l.{order}").alias(order), F.col(f"_l.{value}").alias(value), hits)


def add_hits(cache: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Hits of the log added; counting comes before the join, so a hot key moves once for each partition."""
    counts = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return cache.join(counts, keys, "left").withColumn("hits", F.coalesce("hits", F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_n")


def delete(cache: DataFrame, gone: DataFrame) -> DataFrame:
    """Entries without those of ``gone`` (hash, model); an empty or null model there stands for all models."""
    everywhere = gone.where(F.coalesce("model", F.lit("")) == "").select("hash").distinct()
    some = gone.where(F.coalesce("model", F.lit("")) != "").select("hash", "model").distinct()
    return cache.join(everywhere, "hash", "left_anti").join(some, ["hash", "model"], "left_anti")


def cache_statistics(cache: DataFrame) -> DataFrame:
    """One row: entries, hits and the models in use, sorted and joined by commas."""
    models = F.array_join(F.array_sort(F.collect_set(F.when(F.col("model") != "", F.col("model")))), ",")  # models are few
    return cache.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), models.alias("models"))


def roll_up(metrics: DataFrame, run: str = "run_id") -> DataFrame:
    """Mean score and pass rate over the iterations of each run, to four places."""
    return metrics.groupBy(run).agg(F.count(F.lit(1)).alias("iterations"), text.rounded(F.avg("score"), 4).alias("score"), text.rounded(F.avg("pass_rate"), 4).alias("pass_rate"))


def chat_lines(messages: Column, form: str = "colon") -> Column:
    """Messages as lines, ``role: content`` or ``[role] content``."""
    made = (lambda m: F.concat(m["role"], F.lit(": "), m["content"])) if form == "colon" else (lambda m: F.concat(F.lit("["), m["role"], F.lit("] "), m["content"]))
    return F.array_join(F.transform(messages, made), "\n")


def cleared(table: DataFrame) -> tuple[DataFrame, int]:
    """The table without its rows, and how many there were."""
    return table.limit(0), table.count()
