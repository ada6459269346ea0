"""Bag-of-words cosine between topics and prompts, as joins over an inverted index of tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import fixed, text


def vectors(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, token, count, size (all tokens of the text), norm (of the counts). Texts without tokens have no rows."""
    rows = df.select(key, F.explode(text.tokens(F.col(column))).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("count"))
    sums = rows.groupBy(key).agg(F.sum("count").alias("size"), F.sqrt(F.sum(F.col("count") * F.col("count")).cast("double")).alias("norm"))
    return rows.join(sums, key)


def term_frequencies(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, token, tf."""
    return vectors(df, key, column).select(key, "token", F.round(F.col("count") / F.col("size"), 6).alias("tf"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the token counts of two texts in one row; 0 if either has no tokens."""
    ta, tb = text.tokens(a), text.tokens(b)
    count = lambda ts, t: F.size(F.filter(ts, lambda x: x == t)).cast("double")
    total = lambda ts, f: F.aggregate(F.transform(F.array_distinct(ts), f), F.lit(0.0), lambda s, x: s + x)
    dot = total(F.array_intersect(ta, tb), lambda t: count(ta, t) * count(tb, t))
    norm = lambda ts: F.sqrt(total(ts, lambda t: count(ts, t) * count(ts, t)))
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0).otherwise(dot / (norm(ta) * norm(tb)))


#: Up to so many tokens of all queries are sent to every task; beyond it the entries of frequent tokens are spread.
QUERY_TOKENS, SALTS = 200_000, 16


def similar(queries: DataFrame, corpus: DataFrame, least: float, query: tuple[str, str], entry: tuple[str, str], within: list[str] = ()) -> DataFrame:
    """query id, entry id, similarity (unrounded) of all pairs with a cosine of at least ``least``.

    ``query`` and ``entry`` name the id and the text of either side; ``within`` names columns that must be equal in both.
    Only pairs with a common token meet, through the tokens; for ``least`` > 0 no other pair qualifies. The tokens of few queries are
    broadcast, so that no frequent token is shuffled; those of many are repeated for each of ``SALTS`` parts of the entries.
    """
    q = vectors(queries, query[0], query[1]).select(F.col(query[0]).alias("query_id"), "token", F.col("count").alias("n"), F.col("norm").alias("query_norm"))
    c = vectors(corpus, entry[0], entry[1]).select(F.col(entry[0]).alias("entry_id"), "token", F.col("count").alias("m"), F.col("norm").alias("entry_norm"))
    on = ["token"]
    if within:
        q = q.join(queries.select(F.col(query[0]).alias("query_id"), *within), "query_id")
        c = c.join(corpus.select(F.col(entry[0]).alias("entry_id"), *within), "entry_id")
        on += within
    if q.limit(QUERY_TOKENS + 1).count() <= QUERY_TOKENS:
        q = F.broadcast(q)
    else:
        q = q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        c = c.withColumn("salt", F.pmod(F.xxhash64("entry_id"), F.lit(SALTS)).cast("int"))
        on = [*on, "salt"]
    dots = c.join(q, on).groupBy("query_id", "entry_id", "query_norm", "entry_norm").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    return dots.select("query_id", "entry_id", (F.col("dot") / (F.col("query_norm") * F.col("entry_norm"))).alias("similarity")).where(F.col("similarity") >= least)


def within_age(df: DataFrame, time: str, now: Column, age: str | None) -> DataFrame:
    """Rows whose ``time`` is no further than ``age`` (an interval such as ``30 days``) before ``now``; rows without a time are too old."""
    return df if age is None else df.where(F.col(time) >= now.cast("timestamp") - F.expr(f"interval {age}"))


def similar_runs(queries: DataFrame, runs: DataFrame, query: tuple[str, str], least: float = 0.8, status: str = "completed", age: str | None = None, now: Column | None = None) -> DataFrame:
    """query_id, entry_id (a run), similarity (to three places) of runs of that ``status`` and ``age`` on a similar topic."""
    known = within_age(runs.where(F.lower(F.trim("status")) == status), "started_at", F.current_timestamp() if now is None else now, age)
    return similar(queries, known, least, query, ("id", "topic")).select("query_id", "entry_id", F.round("similarity", 3).alias("similarity"))


def best_match(found: DataFrame, order: DataFrame) -> DataFrame:
    """The most similar entry of each query; ties go to the first in ``order`` (entry_id, place)."""
    ranked = found.join(order, "entry_id")
    best = F.max_by(F.struct("entry_id", "similarity"), F.struct("similarity", -F.col("place")))
    return ranked.groupBy("query_id").agg(best.alias("b")).select("query_id", F.col("b.entry_id").alias("entry_id"), F.round("b.similarity", 3).alias("similarity"))


def cached(queries: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame] | None = None, least: float = fixed.FUZZY_THRESHOLD, age: str | None = None, now: Column | None = None) -> DataFrame:
    """query_id, how (``exact``, ``fuzzy`` or ``computed``), entry_id, response of queries (query_id, hash, model, prompt).

    An entry of ``cache`` (entry_id, hash, model, prompt, response, cached_at) with the same hash and model answers, the newest one where
    there are several; else, for prompts of up to ``fixed.FUZZY_PROMPT_LIMIT`` characters, the most similar entry of the model at ``least``
    or more; else ``compute`` (query_id, response of the rows given; null without it). Null hashes and models match nothing exactly.
    """
    cache = within_age(cache, "cached_at", F.current_timestamp() if now is None else now, age)
    newest = cache.groupBy("hash", "model").agg(F.max_by(F.struct("entry_id", "response"), "entry_id").alias("e"))
    first = queries.join(newest, ["hash", "model"], "left")
    hit = first.where("e is not null").select("query_id", F.lit("exact").alias("how"), "e.entry_id", "e.response")
    open_ = first.where("e is null").select("query_id", "model", "prompt")
    short = open_.where(F.length("prompt") <= fixed.FUZZY_PROMPT_LIMIT)
    near = best_match(similar(short, cache, least, ("query_id", "prompt"), ("entry_id", "prompt"), ["model"]), cache.select("entry_id", F.col("entry_id").alias("place")))
    fuzzy = near.join(cache.select("entry_id", "response"), "entry_id").select("query_id", F.lit("fuzzy").alias("how"), "entry_id", "response")
    rest = open_.join(fuzzy.select("query_id"), "query_id", "left_anti")
    made = compute(rest) if compute else rest.select("query_id", F.lit(None).cast("string").alias("response"))
    return hit.unionByName(fuzzy).unionByName(made.select("query_id", F.lit("computed").alias("how"), F.lit(None).cast("long").alias("entry_id"), "response"))


def exact(queries: DataFrame, cache: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Queries with the cached value of the same keys, null where there is none."""
    return queries.join(cache.select(*keys, value), keys, "left")
