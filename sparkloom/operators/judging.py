"""Scores: parsed from a judge's reply, by heuristics, weighted and summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import fixed, text


def _digit(reply: Column, label: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(reply, rf"(?i){label}[:\s]+([1-5])", 1), F.lit("")).cast("int"), F.lit(3))


def judge_scores(reply: Column) -> Column:
    """(accuracy, relevance, completeness, reasoning, overall) of a reply; 3 where a score is missing."""
    a, r, c = (_digit(reply, x) for x in ("accuracy", "relevance", "completeness"))
    named = reply.rlike(r"(?i)(reasoning|explanation)")
    told = F.substring(text.strip(F.regexp_extract(reply, r"(?is)(?:reasoning|explanation)[:\s]*(.*)", 1)), 1, 500)
    reasoning = F.when(named, told).otherwise(F.substring(reply, 1, 300))
    reasoning = F.when(reasoning == "", F.concat(F.lit("(judge provided no explanation — raw: "), F.substring(reply, 1, 200), F.lit(")"))).otherwise(reasoning)
    return F.struct(a.alias("accuracy"), r.alias("relevance"), c.alias("completeness"), reasoning.alias("reasoning"), F.round(a * 0.4 + r * 0.35 + c * 0.25, 2).alias("overall"))


def single_score(reply: Column) -> Column:
    """(score, reasoning) of a reply to one criterion."""
    score = F.coalesce(F.nullif(F.regexp_extract(reply, r"(?i)Score:\s*([1-5])", 1), F.lit("")).cast("int"), F.lit(3))
    told = F.regexp_extract(reply, r"(?is)Reasoning:\s*(.+)", 1)
    return F.struct(score.alias("score"), F.when(told != "", F.substring(text.strip(told), 1, 500)).otherwise(F.substring(reply, 1, 300)).alias("reasoning"))


def overlap_score(reference: Column, answer: Column) -> Column:
    """1 to 5 by the part of the reference's words that the answer has."""
    words = lambda c: F.array_distinct(text.word_list(F.lower(F.coalesce(c, F.lit("")))))
    ref = words(reference)
    part = F.when(F.size(ref) == 0, 0.0).otherwise(F.size(F.array_intersect(ref, words(answer))) / F.size(ref))
    return F.least(F.greatest(F.floor(1 + part * 4), F.lit(1)), F.lit(5)).cast("int")


def criterion_score(body: Column, name: str) -> Column:
    """Score of a text under one criterion by the signals that occur, up to its ceiling."""
    signals, ceiling = next(((s, c) for n, _, s, c in fixed.CRITERIA if n == name), ([], 4))
    low = F.lower(body)
    hits = sum((F.when(F.contains(low, F.lit(s)), 1).otherwise(0) for s in signals), F.lit(0))
    return F.least(F.lit(ceiling), F.greatest(F.lit(2), hits + 2))


def criterion_rows(docs: DataFrame, key: str, body: str) -> DataFrame:
    """key, criterion, weight, score: each document under each criterion, from one pass over its text."""
    rows = F.array(*(F.struct(F.lit(n).alias("criterion"), F.lit(w).alias("weight"), criterion_score(F.col(body), n).alias("score")) for n, w, _, _ in fixed.CRITERIA))
    return docs.select(key, F.explode(rows).alias("c")).select(key, "c.*")


def weighted(scores: DataFrame, key: str) -> DataFrame:
    """key, weighted: the weighted mean of the scores by criterion; 3 for a missing score, 0 without weights."""
    total = F.sum("weight")
    return scores.groupBy(key).agg(F.coalesce(F.round(F.sum(F.coalesce("score", F.lit(3)) * F.col("weight")) / F.nullif(total, F.lit(0.0)), 3), F.lit(0.0)).alias("weighted"))


def passed(scores: DataFrame, key: str, least: float) -> DataFrame:
    """passed, failed documents: whether all reach ``least``."""
    ok = F.col("weighted") >= least
    return weighted(scores, key).agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("passed"), F.count_if(~ok).alias("failed"))


def summary(results: DataFrame, group: list[str] = ()) -> DataFrame:
    """Means of the four scores, their spread and the pass rate, to three places."""
    mean = lambda c: text.rounded(F.avg(c), 3)
    return results.groupBy(*group).agg(
        F.count(F.lit(1)).alias("samples"), mean("accuracy").alias("accuracy"), mean("relevance").alias("relevance"), mean("completeness").alias("completeness"), mean("overall").alias("overall"),
        text.rounded(F.coalesce(F.stddev_samp("overall"), F.lit(0.0)), 3).alias("overall_stdev"), text.rounded(F.avg(F.col("passed").cast("int")), 3).alias("pass_rate"),
    )


def extremes(results: DataFrame, key: str, score: str, count: int = 3) -> DataFrame:
    """The ``count`` worst and best rows as (which, key, score); ties go to the smaller key."""
    rows = results.where(F.col(score).isNotNull()).select(key, score)
    worst = rows.orderBy(score, key).limit(count).select(F.lit("worst").alias("which"), key, score)
    return worst.unionByName(rows.orderBy(F.desc(score), key).limit(count).select(F.lit("best").alias("which"), key, score))


def loss_score(loss: Column) -> Column:
    """max(0, 1 - loss / 10) to four places; 0 for no number."""
    usable = loss.isNotNull() & ~F.isnan(loss) & (F.abs(loss) != F.lit(float("inf")))
    return F.when(usable, F.round(F.greatest(F.lit(0.0), 1 - loss / 10), 4)).otherwise(0.0)
