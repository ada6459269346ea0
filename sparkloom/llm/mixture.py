"""Problem 9: sources mixed to target shares of all tokens.

Method: weighted fair queueing. Each source's documents, shuffled anew for each repeat, get the virtual finish time
(tokens of the source so far) / (target share). Sorting all copies by it and stopping at the total budget gives each
source its share for as long as it has copies left; a source that runs out leaves its room to the others.

The time at which the budget is reached follows from the sources' totals alone, so copies that could only finish later are never
made. Neither a source nor the global order is sorted in one task: running totals go by ranges of about ``ROWS`` rows.

A null text has 0 tokens and takes no place; null and unknown sources are no part of the mixture; a repeated row is
mixed as often as it stands there. A target that is null or not over 0 is left out; null max_repeats counts as 1.
"""

from __future__ import annotations

import base64
import math
from functools import cache

import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.base import documents, map_chunks
from sparkloom.running import running_total
from sparkloom.shared import table

#: How the tokenizer of ``byte_bpe_50k`` splits a text before merging; a fixed value of the public tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows that are sorted together, about.
ROWS = 100_000


@cache
def encoding(path: str) -> tiktoken.Encoding:
    """The tokenizer of a vocabulary file, read once per process."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _sources(docs: DataFrame, *columns: str) -> DataFrame:
    return documents(docs, "doc_id", "source", *columns).withColumn("source", F.lower(F.trim("source"))).where("source is not null")


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, source (trimmed, lower case), tokens. The file ``vocabulary`` is sent to all executors."""
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = vocabulary.rstrip("/").rsplit("/", 1)[-1]

    def count(data: dict) -> dict:
        encode = encoding(SparkFiles.get(name)).encode_ordinary
        return {"doc_id": data["doc_id"], "source": data["source"], "tokens": [len(encode(t)) if t else 0 for t in data["text"]]}

    return map_chunks(_sources(docs, "text"), "text", "doc_id long, source string, tokens long", count)


def character_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, tokens: sizes in characters instead of tokens."""
    return _sources(docs, "text").select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("tokens"))


def wanted(targets: DataFrame) -> DataFrame:
    """source, share, repeats: one row for each target over 0."""
    rows = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).where("target_share > 0 and max_repeats > 0 and source is not null")
    return rows.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))


def closing_time(sources: list[tuple[int, float, int]], budget: int) -> float:
    """Virtual time at which sources of (tokens, share, repeats) have filled ``budget``; infinite if they never do.

    >>> closing_time([(100, 0.5, 1), (1000, 0.5, 1)], 300)
    400.0
    """
    ends = sorted(n * r / w for n, w, r in sources)
    filled = lambda t: sum(min(n * r, w * t) for n, w, r in sources)
    for end in ends:
        if filled(end) >= budget:
            open_ = [(n, w, r) for n, w, r in sources if n * r / w >= end]
            done = sum(n * r for n, w, r in sources if n * r / w < end)
            return (budget - done) / sum(w for _, w, _ in open_)
    return math.inf


def mix(counts: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 42, rows: int = ROWS) -> DataFrame:
    """place (tokens placed up to and including the row), doc_id, copy, source, tokens of the mixture.

    ``budget`` is the total size in tokens; by default that of ``counts``. The last copy is the first that reaches it.
    """
    counts, want = counts.where("tokens > 0"), wanted(targets)
    totals = counts.groupBy("source").agg(F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("n"), F.max("tokens").alias("largest"))
    sizes = {r.source: r for r in totals.join(F.broadcast(want.select("source")), "source", "left_semi").collect()}  # a row for each target
    if budget is None:
        budget = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    plan = [(r.source, r.share, r.repeats) for r in want.collect() if r.source in sizes]
    # whole documents lag behind a flow of tokens by one document of each source at most
    close = closing_time([(sizes[s].total, w, k) for s, w, k in plan], budget + sum(sizes[s].largest for s, _, _ in plan)) * (1 + 1e-9)
    copies_of = [(s, w, min(k, math.ceil(w * close / sizes[s].total)) if close < math.inf else k, max(1, sizes[s].n // rows)) for s, w, k in plan]
    made = F.broadcast(counts.sparkSession.createDataFrame(copies_of, "source string, share double, copies int, parts long"))  # a row for each target
    copies = counts.join(made, "source").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    copies = copies.withColumn("shuffle", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("copy").cast("string"), F.col("doc_id").cast("string")).cast("binary")))
    order = ["copy", "shuffle", "doc_id"]
    inside = F.floor(F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("double") / 2.0**32 * F.col("parts"))  # hashes are even
    queued = running_total(copies, ["source"], F.col("copy") * F.col("parts") + inside, order, "tokens", "queued")
    timed = table(queued.select("doc_id", "copy", "source", "tokens", "shuffle", (F.col("queued") / F.col("share")).alias("finish")).where(F.col("finish") <= F.lit(close)), "queue")
    order = ["finish", "source", *order]
    ranges = max(1, -(-timed.count() // rows))
    ranked = table(timed.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ranges")
    placed = running_total(ranked, [], F.col("range"), order, "tokens", "place")
    return placed.where(F.col("place") - F.col("tokens") < budget).select("place", "doc_id", "copy", "source", "tokens")


def shares(mixed: DataFrame, counts: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, actual_share, tokens, copies, documents, available_tokens: one row for each target."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"), F.countDistinct("doc_id").alias("documents"))
    total = got.agg(F.sum("tokens").alias("total"))
    there = counts.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    rows = targets.select(F.lower(F.trim("source")).alias("source"), "target_share").join(got, "source", "left").join(there, "source", "left").crossJoin(F.broadcast(total))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("source", "target_share", F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), 6).alias("actual_share"), *(zero(c) for c in ("tokens", "copies", "documents", "available_tokens")))
