"""Corpus analysis: normalised documents, their scores, the quality gate and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom import running
from sparkloom.functions import fixed, rules, text
from sparkloom.operators import chunking


def normalised(docs: DataFrame) -> DataFrame:
    """doc_id, title, source, url, text (cleaned), chars, key; nulls in title, url and text count as empty, a null source as unknown."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select("doc_id", blank("title").alias("title"), F.lower(F.trim(F.coalesce("source", F.lit("unknown")))).alias("source"), blank("url").alias("url"), text.clean(blank("text")).alias("text"))
    return rows.select("*", F.length("text").alias("chars"), text.document_key(F.col("url"), F.col("title")).alias("key"))


def long_enough(docs: DataFrame, least: int = fixed.MIN_CHARS) -> DataFrame:
    """Documents of at least ``least`` characters."""
    return docs.where(F.col("chars") >= least)


def first_by_key(docs: DataFrame, key: str = "key", order: str = "doc_id") -> DataFrame:
    """The first row of each key. Ids are found by a partial aggregate, so a key with most rows is no hot spot."""
    first = docs.groupBy(key).agg(F.min(order).alias(order))
    return docs.join(first, [key, order], "left_semi")


def base_score(body: Column, words: Column, distinct: Column) -> Column:
    """Quality of a text of fifty ``words`` or more, ``distinct`` in lower case: variety, length, less what boilerplate takes away."""
    n = words
    variety = F.least(distinct / n, F.lit(1.0))
    hits = text.count_matching(body, [f"(?i){p}" for p in fixed.BOILERPLATE])
    raw = variety * 0.6 + F.least(n / 2000, F.lit(1.0)) * 0.2 - F.least(hits * 0.15, F.lit(0.5))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def scored(docs: DataFrame, titles: list[str] | None = None) -> DataFrame:
    """Adds words, sentences, score, reason and kind (external or internal)."""
    body = F.col("text")
    # split once; the array is used for the count and the variety, and goes no further
    rows = docs.select("*", text.word_list(F.lower(body)).alias("_list")).select("*", F.size("_list").alias("words"), F.size(F.array_distinct("_list")).alias("_distinct")).drop("_list")
    rows = rows.select("*", text.sentence_count(body).alias("sentences"), rules.personal_reason(body, F.col("title")).alias("_personal"), rules.script_reason(rules.script(body)).alias("_script"))
    empty = text.strip(body) == ""
    reason = F.when(empty, "empty document").when(F.col("_personal") != "", F.col("_personal")).when(F.col("_script") != "", F.col("_script")).when(F.col("words") < 50, "too short").otherwise("")
    rows = rows.select("*", reason.alias("reason"))
    score = F.when(F.col("reason") == "too short", 0.1).when(F.col("reason") != "", 0.0).otherwise(base_score(body, F.col("words"), F.col("_distinct")))
    internal = rules.is_internal(F.col("title"), F.col("source"), titles)
    return rows.select("*", score.alias("score"), F.when(internal, "internal").otherwise("external").alias("kind")).drop("_personal", "_script", "_distinct")


def gate(docs: DataFrame, threshold: float = fixed.QUALITY_THRESHOLD) -> DataFrame:
    """Adds kept and verdict: the reason, else what the score is short of, else empty. The unrounded score decides."""
    kept = (F.col("score") >= threshold) & (F.col("reason") == "")
    short = F.concat(F.lit("quality "), F.round("score", 3).cast("string"), F.lit(f" below {threshold}"))
    return docs.select("*", kept.alias("kept"), F.when(kept, "").when(F.col("reason") != "", F.col("reason")).otherwise(short).alias("verdict"))


def report(docs: DataFrame, threshold: float = fixed.QUALITY_THRESHOLD, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP) -> DataFrame:
    """One row about scored documents and the chunks of those kept, from one pass over the texts.

    Rounded scores count as passing, as reports show them; the unrounded score decides what is kept and chunked.
    """
    sizes = F.transform(chunking.chunks(F.col("text"), size, overlap), F.octet_length)
    kept = (F.col("score") >= threshold) & (F.col("reason") == "")
    rows = docs.select("chars", "reason", "kind", F.round("score", 3).alias("shown"), F.when(kept, sizes).otherwise(F.array().cast("array<int>")).alias("sizes"))
    rows = rows.select("chars", "reason", "kind", "shown", F.size("sizes").cast("long").alias("n"), F.aggregate("sizes", F.lit(0).cast("long"), lambda t, x: t + x + 2).alias("bytes"))
    some, zero = F.count_if, lambda c: F.coalesce(c, F.lit(0))
    external = F.sum(F.when(F.col("kind") == "external", F.col("n")))
    return rows.agg(
        F.count(F.lit(1)).alias("total_docs"),
        some((F.col("shown") >= threshold) & (F.col("reason") == "")).alias("docs_passing_filter"),
        some(F.col("reason").contains("personal document") | F.col("reason").contains("script")).alias("docs_filtered_personal"),
        some((F.col("reason") == "") & (F.col("shown") < threshold)).alias("docs_filtered_quality"),
        zero(F.sum("chars")).alias("total_chars_raw"),
        F.coalesce(text.rounded(F.avg("shown"), 3), F.lit(0.0)).alias("avg_quality_score"),
        some((F.col("kind") == "external") & (F.col("reason") == "")).alias("external_docs"),
        some((F.col("kind") == "internal") & (F.col("reason") == "")).alias("internal_docs"),
        zero(F.sum("n")).alias("total_chunks"),
        zero(external).alias("external_chunks"),
        zero(F.sum(F.when(F.col("kind") == "internal", F.col("n")))).alias("internal_chunks"),
        F.coalesce(F.round(external / F.nullif(F.sum("n"), F.lit(0)), 3), F.lit(0.0)).alias("external_fraction"),
        F.greatest(zero(F.sum("bytes")) - 2, F.lit(0)).alias("total_chars_cleaned"),
    )


def by_source(docs: DataFrame) -> DataFrame:
    """source, documents."""
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))


def low_external(chunks: DataFrame, least: float = fixed.MIN_EXTERNAL) -> DataFrame:
    """A row (chunks, external_fraction) if fewer than ``least`` of the chunks are external."""
    part = F.count_if(F.col("kind") == "external") / F.count(F.lit(1))
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), part.alias("part")).where((F.col("chunks") > 0) & (F.col("part") < least)).select("chunks", F.round("part", 3).alias("external_fraction"))


def best(docs: DataFrame, count: int = 20) -> DataFrame:
    """The ``count`` best documents; ties keep the order of ids."""
    shown = F.round("score", 3).alias("quality")
    return docs.select("doc_id", "source", "words", shown).orderBy(F.desc("quality"), "doc_id").limit(count)


def mean_by(df: DataFrame, group: str, value: str, count: int) -> DataFrame:
    """The ``count`` groups with the highest mean of the values that are there."""
    return df.where(F.col(value).isNotNull()).groupBy(group).agg(text.rounded(F.avg(value), 4).alias("mean")).orderBy(F.desc("mean"), group).limit(count)


def running_mean(df: DataFrame, group: str, order: str, value: str, rows: int = 100_000) -> DataFrame:
    """The mean of ``value`` so far, within each group, rounded down to three places. A group of many rows is summed up in parts of ``rows``."""
    kept = df.select(group, order, F.col(value).cast("double").alias("_value"), F.col(value).isNotNull().cast("long").alias("_one"))
    parts = running.ranged(kept.fillna({"_value": 0.0}), [group, order], rows)
    counted = running.running_total(parts, [group], F.col("_range"), [order], "_one", "_n")
    summed = running.running_total(counted, [group], F.col("_range"), [order], "_value", "_sum")
    return summed.select(group, order, (F.floor(F.try_divide("_sum", "_n") * 1000 + 1e-6) / 1000).alias("so_far"))
