"""Text functions as columns: everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import fixed

S = fixed.SPACE
#: The characters of ``fixed.SPACE``.
SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space on either side, Unicode's included; only the ends are looked at."""
    return F.btrim(c, F.lit(SPACES))


def clean(c: Column) -> Column:
    """Zero-width characters deleted, CRLF and CR to LF, four or more LF to three, runs of blanks and tabs to one blank, stripped."""
    for hidden in "\u200b\u200c\u200d\ufeff":
        c = F.replace(c, F.lit(hidden), F.lit(""))
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return strip(F.regexp_replace(F.regexp_replace(c, r"\n{4,}", "\n\n\n"), r"[ \t]{2,}|\t", " "))


def document_key(url: Column, title: Column) -> Column:
    """First 12 hex digits of the SHA-1 of url and title."""
    return F.substring(F.sha1(F.concat(F.coalesce(url, F.lit("")), F.coalesce(title, F.lit(""))).cast("binary")), 1, 12)


def short_hash(c: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the stripped text."""
    return F.substring(F.sha1(strip(c).cast("binary")), 1, 16)


def word_list(c: Column) -> Column:
    """Words parted by white space."""
    return F.filter(F.split(c, f"{S}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(word_list(c))


def sentence_count(c: Column) -> Column:
    """Runs of full stops, exclamation and question marks."""
    return F.regexp_count(c, F.lit("[.!?]+"))


def sentences(c: Column, longer_than: int = 40) -> Column:
    """Pieces after ``.!?`` and white space that are longer than ``longer_than``."""
    return F.filter(F.split(strip(c), rf"(?<=[.!?]){S}+"), lambda s: F.length(s) > longer_than)


def tokens(c: Column) -> Column:
    """Lower-case words of a-z and 0-9 without stop words and single characters."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1), lambda t: ~t.isin(fixed.STOPWORDS) & (F.length(t) > 1))


def contains_any(c: Column, parts: list[str]) -> Column:
    """Whether one of ``parts`` occurs."""
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(c, F.lit(part))
    return out


def count_matching(c: Column, patterns: list[str]) -> Column:
    """How many of ``patterns`` occur."""
    return sum((F.when(c.rlike(p), 1).otherwise(0) for p in patterns), F.lit(0))


def html_text(c: Column, aside: bool = True) -> Column:
    """Text of HTML: media and frame elements dropped, tags to line feeds, the five basic entities resolved."""
    for tag in fixed.MEDIA_TAGS if aside else fixed.MEDIA_TAGS[:-1]:
        c = F.regexp_replace(c, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    c = F.regexp_replace(c, r"<[^>]+>", "\n")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(c, rf"{S}*\n{S}*", "\n"))


def html_tags_to_spaces(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def html_title(c: Column, url: Column) -> Column:
    """The title element, else the host of the url."""
    title = strip(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(title != "", title).otherwise(F.coalesce(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def slug(c: Column, size: int = 40) -> Column:
    """Lower case, everything but a-z and 0-9 to single hyphens, none at the ends."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, size)


def function_slug(c: Column) -> Column:
    """Lower case, everything but a-z and 0-9 to single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def program_slug(c: Column) -> Column:
    """Lower case, blanks to hyphens, the first 40 characters."""
    return F.substring(F.replace(F.lower(c), F.lit(" "), F.lit("-")), 1, 40)


def content_hash(content: Column) -> Column:
    """First 16 digits of the SHA-1 of the first 512 KiB of a file's bytes, which is all that fingerprint is defined on."""
    return F.substring(F.sha1(F.substring(content, 1, 512 * 1024)), 1, 16)


def file_stamp(modified: Column, size: Column) -> Column:
    """Time of change in nanoseconds and size, joined by a colon."""
    return F.concat((F.unix_micros(modified) * 1000).cast("string"), F.lit(":"), size.cast("string"))


def minute(c: Column) -> Column:
    """An ISO time as ``yyyy-MM-dd HH:mm``; the text itself where it is none, a dash where it is empty or null."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd HH:mm"), F.nullif(c, F.lit("")), F.lit("—"))


def criterion_prompt(question: Column, document: Column) -> Column:
    """What a judge is asked on a criterion; the prompt is defined on the first 8,000 characters of the document."""
    return F.concat(F.lit("Evaluation question: "), question, F.lit("\n\n--- Document to evaluate ---\n"), F.substring(document, 1, 8000), F.lit("\n--- End of document ---"))


def judge_prompt(question: Column, reference: Column, answer: Column) -> Column:
    """What a judge is asked on an answer; the prompt is defined on the first 800 characters of either answer."""
    return F.concat(F.lit("Question: "), question, F.lit("\n\nReference answer: "), F.substring(reference, 1, 800), F.lit("\n\nModel answer to evaluate: "), F.substring(answer, 1, 800))


def report_prompt(topic: Column, extract: Column, note: Column, focus: Column, extra: str = "") -> Column:
    """What a model is asked for a report on an extract of the corpus."""
    lines = [F.concat(F.lit("Research topic: "), topic), F.lit(""), note, focus, *([F.lit(extra)] if extra else []), F.concat(F.lit("--- Corpus extract ("), F.format_number(F.length(extract), 0), F.lit(" chars) ---")), extract, F.lit("--- End of extract ---")]
    return strip(F.concat_ws("\n", *(F.coalesce(x, F.lit("")) for x in lines)))


def sample_window(c: Column, most: int = fixed.SAMPLE_WINDOW) -> Column:
    """The whole text up to ``most`` characters, else a third each of its head, middle and tail with marks between."""
    third = most // 3
    middle = F.substring(c, F.floor(F.length(c) / 2).cast("int") - third // 2 + 1, F.lit(third))
    joined = F.concat(F.substring(c, 1, third), F.lit(f"\n\n{fixed.MIDDLE_MARK}\n\n"), middle, F.lit(f"\n\n{fixed.END_MARK}\n\n"), F.right(c, F.lit(third)))
    return F.when(F.length(c) <= most, c).otherwise(joined)


def rounded(c: Column, places: int) -> Column:
    """Half up, ties decided alike whatever the order in which a mean was summed up."""
    return F.floor(c * 10**places + 0.5000001) / 10**places
