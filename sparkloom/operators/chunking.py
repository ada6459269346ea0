"""Chunks of texts along paragraphs, and windows of whole corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import fixed, text


def paragraphs(c: Column) -> Column:
    """Pieces between blank lines of the stripped text."""
    return F.split(text.strip(c), "\n\n+")


def pieces(c: Column, size: int = fixed.CHUNK_SIZE) -> Column:
    """Paragraphs; longer ones cut at the last blank before ``size``, or at ``size``. A piece after a cut begins at the blank and is stripped."""
    pattern = rf"(?s)(.{{1,{size}}}\z|.{{1,{size - 1}}}(?= )|.{{{size}}})"
    cut = lambda p: F.transform(F.regexp_extract_all(p, F.lit(pattern), 1), text.strip)
    return F.flatten(F.transform(paragraphs(c), lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(cut(p))))


def chunks(c: Column, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP) -> Column:
    """Pieces packed greedily; each chunk but the first begins with the last ``overlap`` characters of the one before."""
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def pack(state: Column, piece: Column) -> Column:
        cur, out = state["cur"], state["out"]
        full = (F.length(cur) + F.length(piece) + 2 > size) & (cur != "")
        kept = F.concat(F.right(cur, F.lit(overlap)), F.lit("\n\n"), piece) if overlap > 0 else piece
        longer = F.when(cur != "", F.concat(cur, F.lit("\n\n"), piece)).otherwise(piece)
        return F.struct(F.when(full, F.concat(out, F.array(text.strip(cur)))).otherwise(out).alias("out"), F.when(full, kept).otherwise(longer).alias("cur"))

    def finish(state: Column) -> Column:
        last = text.strip(state["cur"])
        return F.when(last != "", F.concat(state["out"], F.array(last))).otherwise(state["out"])

    return F.aggregate(pieces(c, size), empty, pack, finish)


def chunk_documents(docs: DataFrame, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP) -> DataFrame:
    """doc_id, kind, chunk_no, chunk of documents that have doc_id, kind and text. A null or blank text has no chunks."""
    return docs.select("doc_id", "kind", F.posexplode(chunks(F.coalesce("text", F.lit("")), size, overlap)).alias("chunk_no", "chunk"))


def cleaned_corpus(chunked: DataFrame) -> DataFrame:
    """Chunks with their place in the corpus file: external ones first, then in order of document and number."""
    return chunked.select("doc_id", "kind", "chunk_no", "chunk", (F.col("kind") == "internal").cast("int").alias("part"))


def answerable(chunked: DataFrame, longer_than: int = 150) -> DataFrame:
    """Passages for questions: chunks split at blank lines again, those longer than ``longer_than``."""
    again = F.posexplode(F.transform(F.split("chunk", "\n\n+"), text.strip)).alias("passage_no", "passage")
    return chunked.select("doc_id", "chunk_no", again).where(F.length("passage") > longer_than)


def weighted_window(external: Column, main: Column, most: int = fixed.SAMPLE_WINDOW, fraction: float = fixed.EXTERNAL_FRACTION) -> Column:
    """A window of ``most`` characters, ``fraction`` of it from the external text, the rest from the main one."""
    budget = int(most * fraction)
    own = text.sample_window(main, most - budget)
    tail = F.when(text.strip(own) != "", F.concat(F.lit("\n\n[--- Additional context from project codebase ---]\n\n"), own)).otherwise("")
    return F.concat(text.sample_window(external, budget), tail)


def corpus_window(external: Column | None, main: Column, most: int = fixed.SAMPLE_WINDOW, fraction: float = fixed.EXTERNAL_FRACTION) -> Column:
    """(text, note): the weighted window with a note on its mix; without an external corpus, or where it is null, one of the main corpus."""
    share = int(fraction * 100)
    plain = F.struct(text.sample_window(main, most).alias("text"), F.lit("(Using combined corpus — no external corpus to sample first)").alias("note"))
    if external is None:
        return plain
    mixed = F.struct(weighted_window(external, main, most, fraction).alias("text"), F.lit(f"(Corpus mix: ~{share}% external research sources, ~{100 - share}% project codebase context)").alias("note"))
    return F.when(external.isNull(), plain).otherwise(mixed)
