"""Questions and answers: generation, records, shuffles and splits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text


def to_question(sentence: Column) -> Column:
    """A question that the sentence answers."""
    s = F.regexp_replace(text.strip(sentence), r"\.+$", "")
    low = F.lower(s)
    first = F.regexp_extract(low, r"^(\S+)", 1)
    rest = text.strip(F.substring(low, F.length(first) + 1, F.length(low)))
    return (
        F.when(s.rlike(r"^[A-Z][a-z]+ (is|are|was|were) "), F.concat(F.lit("What "), F.regexp_replace(s, r"^\S+ ", ""), F.lit("?")))
        .when(first.isin("the", "a", "an", "this", "these", "it"), F.concat(F.lit("What is "), low, F.lit("?")))
        .when(first.isin("we", "researchers", "scientists"), F.concat(F.lit("How did "), rest, F.lit("?")))
        .otherwise(F.concat(F.lit("What do we know about: "), s, F.lit("?")))
    )


def pairs(df: DataFrame, keys: list[str], passage: str, most: int = 5) -> DataFrame:
    """``keys``, pair_no, question, answer: a question from each of the first ``most`` sentences, answered by it and the two that follow."""
    told = df.select(*keys, text.sentences(F.col(passage)).alias("_s"))
    rows = told.select(*keys, "_s", F.posexplode(F.slice("_s", 1, most)).alias("pair_no", "_first"))
    return rows.select(*keys, "pair_no", to_question(F.col("_first")).alias("question"), F.array_join(F.slice("_s", F.col("pair_no") + 1, 3), " ").alias("answer"))


def record(question: Column, answer: Column, context: Column, system: str, program: str = "") -> Column:
    """A training record of system, user and assistant messages and its context of 512 characters."""
    told = F.lit(system + ("\n\nResearch context:\n" + program[:500] if program else ""))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.struct(F.array(message("system", told), message("user", question), message("assistant", answer)).alias("messages"), F.substring(context, 1, 512).alias("context"))


def shuffle_key(seed: int, *keys: Column) -> Column:
    """Place of a row in a shuffle that only depends on the seed and the row."""
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)).cast("binary"))


def split(df: DataFrame, keys: list[str], fraction: float, seed: int = 42) -> DataFrame:
    """Adds split: ``val`` for the first max(1, floor(n * fraction)) rows of the shuffle, else ``train``.

    The bound is found by a top-k of keys, so no task sorts all rows. Rows with equal keys must not occur.
    """
    keyed = df.withColumn("_key", shuffle_key(seed, *(F.col(k) for k in keys)))
    n = keyed.count()
    if not n:
        return keyed.withColumn("split", F.lit("train")).drop("_key")
    take = max(1, int(n * fraction))
    hexes = 8  # a histogram over the first digits of the keys narrows the bound down to one bucket
    prefix = F.substring("_key", 1, hexes // 2)
    so_far = F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    counts = keyed.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n"))  # 65,536 rows at most
    at = counts.select("p", "n", so_far.alias("s")).where(F.col("s") >= take).orderBy("p").first()
    inside = take - (at.s - at.n)
    bound = keyed.where(prefix == at.p).select("_key").orderBy("_key").limit(inside).agg(F.max("_key")).first()[0]
    return keyed.withColumn("split", F.when(F.col("_key") <= bound, "val").otherwise("train")).drop("_key")


def capped(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows in the given order."""
    return df.orderBy(*order).limit(most)


def first_content(messages: Column, role: str) -> Column:
    """Content of the first message of a role; null if there is none."""
    return F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"]


def quiz_pairs(df: DataFrame, keys: list[str], quiz: str, most: int = 500) -> DataFrame:
    """``keys``, pair_no, question, answer of a quiz in JSON, from its first ``most`` questions.

    The answer is the first right option and the hint after ``. ``, or either of them alone; a question or answer that is empty has no row.
    """
    schema = "struct<questions: array<struct<question: string, answerOptions: array<struct<text: string, isCorrect: boolean>>, hint: string>>>"
    rows = df.select(*keys, F.posexplode(F.slice(F.from_json(quiz, schema)["questions"], 1, most)).alias("pair_no", "_q"))
    right = F.nullif(F.get(F.filter("_q.answerOptions", lambda o: o["isCorrect"]), F.lit(0))["text"], F.lit(""))
    answer = text.strip(F.concat_ws(". ", right, F.nullif(F.col("_q.hint"), F.lit(""))))
    return rows.select(*keys, "pair_no", text.strip(F.col("_q.question")).alias("question"), answer.alias("answer")).where("question <> '' and answer <> ''")


def parse_answer(reply: Column) -> Column:
    """(question, answer) of a reply in the form ``Q: … A: …``, else of its first line and the rest; null if there is no second line."""
    q = text.strip(F.regexp_extract(reply, r"(?i)(?:Q:|Question:)\s*(.+?)(?:\n|\z)", 1))
    a = F.substring(text.strip(F.regexp_extract(reply, r"(?is)(?:A:|Answer:)\s*(.+)", 1)), 1, 1024)
    lines = F.filter(F.transform(F.split(reply, "\n"), text.strip), lambda x: x != "")
    named = (F.regexp_extract(reply, r"(?i)(Q:|Question:)\s*.", 1) != "") & (F.regexp_extract(reply, r"(?is)(A:|Answer:)\s*.", 1) != "")
    pair = lambda x, y: F.struct(x.alias("question"), y.alias("answer"))
    rest = F.substring(F.array_join(F.slice(lines, 2, 10**6), " "), 1, 1024)
    return F.when(named, pair(q, a)).when(F.size(lines) >= 2, pair(F.get(lines, F.lit(0)), rest))


def contexts(df: DataFrame, key: str, question: str, chunks: DataFrame, words: int = 5, block: int = 200_000) -> DataFrame:
    """``key``, place, chunk: the first chunk (place, chunk) that holds one of a question's first ``words`` words, as it is written, anywhere.

    Without such a chunk it is the first of all. Chunks are scanned where they lie, once for each ``block`` of distinct words, by a
    multi-pattern automaton; each task gives back the first place of each word, so nothing grows with chunks times words.
    """
    spark = df.sparkSession
    asked = df.select(key, F.explode_outer(F.array_distinct(F.slice(F.filter(F.split(text.strip(F.coalesce(question, F.lit(""))), r"\s+"), lambda w: w != ""), 1, words))).alias("word"))
    distinct = asked.where("word is not null").select("word").distinct()
    blocks = max(1, -(-distinct.count() // block))
    places = spark.createDataFrame([], "word string, place long")
    for i in range(blocks):
        some = [r.word for r in distinct.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == i).collect()]  # one block of words at a time
        if some:
            places = places.unionByName(chunks.select("place", "chunk").mapInArrow(_first_places(some), "word string, place long").groupBy("word").agg(F.min("place").alias("place")))
    best = asked.join(places, "word", "left").groupBy(key).agg(F.min("place").alias("place"))
    first = chunks.agg(F.min("place").alias("first"))
    placed = best.crossJoin(F.broadcast(first)).select(key, F.coalesce("place", "first").alias("place"))  # one row
    return placed.join(chunks.select("place", "chunk"), "place", "left").select(key, "place", F.coalesce("chunk", F.lit("")).alias("chunk"))


def _first_places(words: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word in words:
            automaton.add_word(word, word)
        automaton.make_automaton()
        least: dict[str, int] = {}
        for batch in batches:
            for place, chunk in zip(batch.column("place").to_pylist(), batch.column("chunk").to_pylist()):
                for word in {w for _, w in automaton.iter(chunk or "")}:
                    if place < least.get(word, place + 1):
                        least[word] = place
        yield pa.RecordBatch.from_arrays([pa.array(least.keys(), pa.string()), pa.array(least.values(), pa.int64())], names=["word", "place"])

    return run
