"""Structure found in texts: sections, code, concepts, word pairs, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text


def word_pairs(df: DataFrame, key: str, body: str, most: int) -> DataFrame:
    """key, place, pair, n: the most frequent pairs of neighbouring words of four letters or more; ties by first appearance."""
    words = F.regexp_extract_all(F.lower(F.col(body)), F.lit(r"\b([a-z]{4,})\b"), 1)
    rows = df.select(key, words.alias("w")).where(F.size("w") > 1)
    pairs = rows.select(key, F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))).alias("at", "pair"))
    counted = pairs.groupBy(key, "pair").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "at"))
    return counted.withColumn("place", place).where(F.col("place") <= most).select(key, "place", "pair", "n")


def code_blocks(body: Column, most: int = 6, longer_than: int = 40) -> Column:
    """(language, code) of fenced blocks over ``longer_than`` characters, longest first, at most ``most``."""
    pattern = F.lit(r"(?s)```(\w*)\n(.*?)```")
    made = F.zip_with(F.regexp_extract_all(body, pattern, 1), F.regexp_extract_all(body, pattern, 2), lambda lang, code: F.struct(F.when(lang == "", "python").otherwise(lang).alias("language"), text.strip(code).alias("code")))
    long = F.filter(made, lambda b: F.length(b["code"]) > longer_than)
    placed = F.transform(long, lambda b, i: F.struct(-F.length(b["code"]), i, b["language"].alias("language"), b["code"].alias("code")))
    return F.slice(F.transform(F.array_sort(placed), lambda b: F.struct(b["language"].alias("language"), b["code"].alias("code"))), 1, most)


def concepts(body: Column) -> Column:
    """Headings of level 1 to 3, then bold phrases that are no heading, in order; empty if there are neither."""
    heads = F.transform(F.regexp_extract_all(body, F.lit(r"(?m)^#{1,3}[ \t]+(.+)$"), 1), lambda h: F.regexp_replace(text.strip(h), r"\.+$", ""))
    heads = F.filter(heads, lambda h: (F.length(h) > 4) & (F.length(h) < 80))
    bold = F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(r"\*\*([^*]{4,60})\*\*"), 1), text.strip))
    return F.concat(heads, F.array_except(bold, heads))


def key_concepts(df: DataFrame, key: str, body: str, most: int = 8) -> DataFrame:
    """key, place, concept: concepts, or the most frequent word pairs of texts without any."""
    rows = df.select(key, body, F.slice(concepts(F.col(body)), 1, most).alias("c"))
    named = rows.where(F.size("c") > 0).select(key, F.posexplode("c").alias("i", "concept")).select(key, (F.col("i") + 1).alias("place"), "concept")
    pairs = word_pairs(rows.where(F.size("c") == 0), key, body, most).select(key, "place", F.col("pair").alias("concept"))
    return named.unionByName(pairs)


def sections(body: Column) -> Column:
    """Map of heading (lower case, blanks to ``_``) to body for second-level headings; the last of equal headings wins.

    Every section is there by its place as well: ``_section_0``, ``_section_1``, …
    """
    pattern = F.lit(r"(?s)##\s+([^\n]+)\n(.*?)(?=\n##\s|\z)")
    keys = F.transform(F.regexp_extract_all(body, pattern, 1), lambda h: F.replace(F.lower(text.strip(h)), F.lit(" "), F.lit("_")))
    values = F.transform(F.regexp_extract_all(body, pattern, 2), text.strip)
    entries = F.transform(keys, lambda k, i: F.struct(k.alias("key"), F.get(values, i).alias("value"), i.alias("i")))
    last = F.filter(entries, lambda e: ~F.exists(entries, lambda o: (o["key"] == e["key"]) & (o["i"] > e["i"])) & ~e["key"].rlike(r"^_section_\d+$"))
    placed = F.transform(entries, lambda e: F.struct(F.concat(F.lit("_section_"), e["i"].cast("string")).alias("key"), e["value"].alias("value")))
    return F.map_from_entries(F.concat(F.transform(last, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))), placed))


def first_section(found: Column, names: list[str], default: str = "_No content generated._") -> Column:
    """Body of the first of ``names`` that is there."""
    return F.coalesce(*(F.try_element_at(found, F.lit(n.lower().replace(" ", "_"))) for n in names), F.lit(default))


def coverage(found: Column, expected: list[str]) -> Column:
    """Percentage, rounded down, of expected headings that are there."""
    names = [n.lower().replace(" ", "_") for n in expected]
    return F.floor(F.size(F.array_intersect(F.map_keys(found), F.array(*map(F.lit, names)))) * 100 / max(1, len(names))).cast("int")


def json_object(reply: Column, keys: list[str]) -> Column:
    """Map of strings of the JSON object in a reply, fenced or from its first brace; null unless it has all ``keys``."""
    fenced = F.regexp_extract(reply, r"(?i)```json\s*([\s\S]+?)```", 1)
    candidate = F.when(fenced != "", fenced).otherwise(reply)
    candidate = text.strip(F.regexp_replace(candidate, r"^[^{]*", ""))
    parsed = F.from_json(candidate, "map<string,string>")
    whole = candidate.rlike(r"(?s)^\{.*\}$")
    has_all = F.lit(True)
    for key in keys:
        has_all = has_all & F.map_contains_key(parsed, key)
    return F.when(whole & has_all, parsed)


def detect_topic(program: Column) -> Column:
    """The first heading or ``topic:`` line; null if there is none."""
    return F.nullif(text.strip(F.regexp_extract(program, r"(?im)^(?:#[ \t]*|topic:[ \t]*)(.+)$", 1)), F.lit(""))


def topics(df: DataFrame, key: str, program: str, body: str) -> DataFrame:
    """key, topic: that of the program, else the three most frequent word pairs of the text, else ``research findings``."""
    named = df.select(key, detect_topic(F.col(program)).alias("named"), body)
    pairs = word_pairs(named.where("named is null"), key, body, 3).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "pair"))), lambda p: p["pair"]), ", ").alias("pairs"))  # three of each
    return named.select(key, "named").join(pairs, key, "left").select(key, F.coalesce("named", "pairs", F.lit("research findings")).alias("topic"))


def replace_topic(program: Column, topic: str) -> Column:
    """The program with the line after each heading ``## Topic`` replaced."""
    return F.regexp_replace(program, r"(## Topic\s*\n)([^\n]+)", "$1" + topic.replace("\\", r"\\").replace("$", r"\$"))
