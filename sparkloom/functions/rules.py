"""Classifiers as columns: ordered rules over text, in whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import fixed, text


def in_personal_folder(path: Column) -> Column:
    """Whether a part of the path, of either notation, is a folder for personal files."""
    return F.exists(F.split(F.lower(path), r"[/\\]"), lambda p: p.isin(fixed.PERSONAL_FOLDERS))


def is_internal(title: Column, source: Column, titles: list[str] | None = None, external: list[str] | None = None) -> Column:
    """Whether a document is the project's own; sources in ``external`` never are. Empty lists mean the defaults."""
    external, titles = external or fixed.ALWAYS_EXTERNAL, titles or fixed.INTERNAL_TITLES
    return ~F.coalesce(F.lower(source), F.lit("")).isin(external) & text.contains_any(F.coalesce(F.lower(title), F.lit("")), titles)


def personal_reason(body: Column, title: Column) -> Column:
    """Why a document is personal; empty if it isn't. The title decides before the body."""
    # all patterns begin at a word boundary: tested once, it spares most positions the alternatives
    inner = "|".join(p.removeprefix(r"\b").replace("é", "[éÉ]") for p in fixed.PERSONAL_BODY)
    found = F.regexp_extract(body, rf"(?is)\b(?:{inner})", 0)
    snippet = F.replace(F.substring(found, 1, 60), F.lit("\n"), F.lit(" "))
    by_title = F.concat(F.lit("personal document title: '"), title, F.lit("'"))
    return F.when(F.coalesce(title, F.lit("")).rlike("(?iu)" + fixed.PERSONAL_TITLE), by_title).when(found != "", F.concat(F.lit("personal document pattern: '"), snippet, F.lit("'"))).otherwise("")


def script(body: Column) -> Column:
    """(script, fraction): the foremost of six other scripts if over a fifth of all and half of the Latin part, else latin."""
    total = F.greatest(F.length(body), F.lit(1))
    part = lambda range_: (F.length(body) - F.length(F.regexp_replace(body, f"[{range_}]+", ""))) / total
    ranges = [(name, f"\\x{{{low}}}-\\x{{{high}}}") for name, low, high in fixed.SCRIPTS]
    latin = part("a-zA-Z\\x{212A}")
    counted = F.array(*(F.struct(part(r).alias("fraction"), F.lit(-i).alias("place"), F.lit(n).alias("script")) for i, (n, r) in enumerate(ranges)))
    # most texts have no character of another script: one scan tells
    best = F.when(body.rlike("[" + "".join(r for _, r in ranges) + "]"), F.array_max(counted))
    return F.transform(F.array(F.struct(best.alias("b"), latin.alias("latin"))), lambda x: F.when((x["b"]["fraction"] > 0.20) & (x["b"]["fraction"] > x["latin"] * 0.5), F.struct(x["b"]["script"].alias("script"), x["b"]["fraction"].alias("fraction"))).otherwise(F.struct(F.lit("latin").alias("script"), x["latin"].alias("fraction"))))[0]


def script_reason(found: Column) -> Column:
    """Why a text is in no language of research, from ``script``; empty if it is."""
    percent = F.floor(found["fraction"] * 100).cast("string")
    return F.when((found["script"] != "latin") & (found["fraction"] > 0.20), F.concat(percent, F.lit("% "), found["script"], F.lit(" script — likely not research content"))).otherwise("")


def topic_class(topic: Column) -> Column:
    """The first class with a word that occurs, else code."""
    low = F.lower(topic)
    out = F.lit("code")
    for name, words in reversed(fixed.TOPIC_RULES):
        out = F.when(text.contains_any(low, words), name).otherwise(out)
    return out


def input_class(body: Column, hint: Column | None = None) -> Column:
    """A valid hint, else the class with most signals in the first 10,000 characters if it has two at least, else text."""
    head = F.substring(body, 1, 10_000)
    counts = [(name, text.count_matching(head, patterns)) for name, patterns in fixed.INPUT_SIGNALS]
    most = F.greatest(*(n for _, n in counts))
    found = F.lit("text")
    for name, n in reversed(counts):
        found = F.when((n == most) & (most >= 2), name).otherwise(found)
    if hint is None:
        return found
    said = F.regexp_replace(F.lower(text.strip(hint)), "[- ]", "_")
    return F.when(said.isin([n for n, _ in counts] + ["text"]), said).otherwise(found)


def model_parts(model: Column) -> Column:
    """(provider, name, base) of a model string."""
    rest = F.substring(model, 8, 2**30)
    url = F.when(F.contains(rest, F.lit("@")), F.regexp_replace(rest, "^[^@]*@", "")).otherwise(fixed.OLLAMA_BASE)
    make = lambda provider, name, url_: F.struct(F.lit(provider).alias("provider"), name.alias("name"), url_.cast("string").alias("base"))
    return (
        F.when(model.startswith("ollama:"), make("ollama", F.trim(F.regexp_replace(rest, "(?s)@.*$", "")), F.regexp_replace(url, "/+$", "")))
        .when(model.startswith("claude"), make("anthropic", model, F.lit(None)))
        .when(model.startswith("gemini"), make("google", model, F.lit(None)))
        .otherwise(make("openai", model, F.lit(None)))
    )


def fences_closed(body: Column) -> Column:
    """Whether the lines that begin with three backticks are even in number."""
    return F.regexp_count(body, F.lit("(?m)^```")) % 2 == 0


def is_rate_limit(message: Column) -> Column:
    return text.contains_any(F.lower(message), fixed.RATE_LIMITS)


def domains(body: Column, most: int = 4) -> Column:
    """Labels of the first ``most`` domains whose keyword occurs."""
    low = F.lower(body)
    found = F.array(*(F.when(F.contains(low, F.lit(word)), F.lit(label)) for word, label in fixed.DOMAINS))
    return F.slice(F.array_compact(found), 1, most)


def badge(score: Column) -> Column:
    """green from 0.75, amber from 0.5, else red; a dash for none."""
    return F.when(score.isNull(), "—").when(score >= 0.75, "green").when(score >= 0.5, "amber").otherwise("red")


def score_badge(score: Column) -> Column:
    """A coloured dot and the score to three places; a dash for none."""
    dot = F.when(score >= 0.75, "🟢").when(score >= 0.5, "🟡").otherwise("🔴")
    return F.when(score.isNull(), "—").otherwise(F.concat(dot, F.lit(" "), F.format_string("%.3f", score)))


def status_badge(status: Column) -> Column:
    """A sign for the known states of a run, others as they are."""
    return F.when(status == "completed", "✅").when(status == "running", "⏳").when(status == "failed", "❌").otherwise(status)
