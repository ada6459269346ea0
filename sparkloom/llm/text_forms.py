"""Problem 1: per-document figures that tell natural prose from lists, tables and junk.

Method: an ordered rule list is induced by incremental reduced-error pruning on labelled documents; the learned
thresholds become a SQL CASE expression over the figures, which Spark evaluates natively.

The figures are plain ones (words, word length, symbols, ended lines, common words, delimiters …), counted line by line
in numpy and summed up by document, so that a site's recurring lines drop out by a join of line hashes and no text moves.
The labelled documents are ``SAMPLE`` real ones of the table, chosen by a hash of their id and rated by ``form_labels``;
a table with fewer than ``LEAST`` is filled up with composed documents of known form.

A null or empty text has zero figures and the form ``prose``; a repeated row of one id adds its figures to the others;
null ids are left out; a document without ``doc_stats`` has nulls for the figures stored there.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import form_labels, rule_lists, site_lines
from sparkloom.llm import textkernel as K
from sparkloom.llm.base import BROADCAST_ROWS, documents, map_chunks, site
from sparkloom.shared import table

#: Labelled documents that the rules are learned from.
SAMPLE = 4000
#: With fewer rated documents than this, composed ones are added up to that number.
LEAST = 1000
FORMS = form_labels.FORMS

#: What is counted in each line. ``stops`` are marks that end a sentence, runs of marks aside; ``tight`` ones have no space behind them.
COUNTS = [
    "lines", "chars", "words", "letters", "digits", "symbols", "ended", "stops", "common", "glue", "marks", "commas", "tight", "semicolons",
    "colons", "bars", "tabs", "gaps", "slashes", "dots", "singles", "lengthy", "mixed", "distinct", "repeats", "short",
]
#: Figures as shares of counts; what the rules test.
RATIOS = {
    "mean_word": ("letters", "words"), "symbol_share": ("symbols", "chars"), "digit_share": ("digits", "chars"), "ended_lines": ("ended", "lines"),
    "common_words": ("common", "words"), "glue_words": ("glue", "words"), "words_a_line": ("words", "lines"), "chars_a_line": ("chars", "lines"),
    "sentence_share": ("stops", "words"), "stops_a_line": ("stops", "lines"), "marked_lines": ("marks", "lines"), "comma_share": ("commas", "words"), "tight_share": ("tight", "words"),
    "semicolon_share": ("semicolons", "words"), "colons_a_line": ("colons", "lines"), "bars_a_line": ("bars", "lines"), "tabs_a_line": ("tabs", "lines"),
    "gaps_a_line": ("gaps", "lines"), "slashes_a_line": ("slashes", "lines"), "dot_share": ("dots", "chars"), "single_share": ("singles", "words"), "lengthy_share": ("lengthy", "words"),
    "mixed_share": ("mixed", "words"), "distinct_share": ("distinct", "words"), "repeat_share": ("repeats", "words"), "short_lines": ("short", "lines"), "spelled": ("letters", "chars"),
}

_PLAIN = frozenset(".,:;!?…'\"()-–—‘’“”„«»/%&")
_END = frozenset(".!?…")
_MARKS = frozenset(".)]-*•‣◦·–—+»")
_SPACE, _SYMBOL, _STOP, _MARK, _CLOSE = 1, 2, 4, 8, 16
_LIMIT = 0x20000
_tables: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def _flags() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flags of each code point, and the sorted hashes of common and of glue words; made once per process."""
    global _tables
    if _tables is None:
        flags = np.zeros(_LIMIT, np.uint8)
        for code in range(_LIMIT):
            char = chr(code)
            group = unicodedata.category(char)[0]
            if group in "ZC":
                flags[code] = _SPACE
            elif group not in "LMN" and char not in _PLAIN:
                flags[code] = _SYMBOL
            flags[code] |= _STOP * (char in _END) | _MARK * (char in _MARKS) | _CLOSE * (char in "\"”’)»'")
        hashes = lambda words: np.unique(K.words([" ".join(sorted(words))]).hash)
        _tables = flags, hashes(form_labels.GLUE | form_labels.ARTICLES), hashes(form_labels.GLUE)
    return _tables


def _known(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    return words[np.minimum(np.searchsorted(words, hashes), len(words) - 1)] == hashes


def line_counts(texts: list) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Text and number of each non-blank line, its ``COUNTS``, the hash of its words of letters, and whether it has any.

    >>> _, number, counts, _, _ = line_counts(["- a Fig\\n\\nIt rained, 7x."])
    >>> number.tolist(), counts["words"].tolist(), counts["marks"].tolist(), counts["ended"].tolist(), counts["mixed"].tolist()
    ([0, 2], [2, 3], [1, 0], [0, 1], [0, 1])
    """
    w = K.words(texts)
    codes, flags = w.codes, _flags()
    flag = np.where(codes < _LIMIT, flags[0][np.minimum(codes, _LIMIT - 1)], 0).astype(np.uint8)
    n = len(codes)
    feed = np.flatnonzero(codes == 10)
    start, end = np.concatenate([[0], feed[:-1] + 1]) if len(feed) else feed, feed
    visible = (flag & _SPACE) == 0
    shown = np.flatnonzero(visible)
    total = lambda mask: np.concatenate([np.zeros(1, np.int32), np.cumsum(mask, dtype=np.int32)])
    count_shown = total(visible)
    row = np.flatnonzero(count_shown[end] > count_shown[start])  # lines that show anything
    start, end = start[row], end[row]

    def dense(mask: np.ndarray) -> np.ndarray:
        t = total(mask)
        return t[end] - t[start]

    def rare(mask: np.ndarray, a: np.ndarray = start) -> np.ndarray:
        """Marked places by line, from ``a`` on; cheap where few are marked."""
        place = np.flatnonzero(mask)
        line = np.minimum(np.searchsorted(end, place), len(row) - 1)
        return np.bincount(line[(place >= a[line]) & (place < end[line])], minlength=len(row)) if len(row) else np.zeros(0, np.int64)

    first, last = shown[count_shown[start]] if len(row) else start, shown[count_shown[end] - 1] if len(row) else end
    after = np.append(codes[1:], 10)
    space_after = np.append(~visible[1:], True)
    letter, digit = w.kind == K.LETTER, w.kind == K.DIGIT
    stop = (flag & _STOP) > 0
    close = (flag & _CLOSE) > 0

    # the mark that begins an entry: a first token of up to 8 characters that ends with a sign and has others behind it
    gap_at = np.flatnonzero(~visible)
    token_end = gap_at[np.searchsorted(gap_at, first)] if len(row) else first
    lead = token_end - first
    mark = (token_end < last) & (((flag[np.maximum(token_end - 1, 0)] & _MARK) > 0) & ((lead <= 3) | ((codes[first] == 91) & (lead <= 8))))
    # wide gaps between visible characters
    edge = np.diff(np.concatenate([[False], ~visible & (codes != 10) & (codes != 9), [False]]).astype(np.int8))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    wide = np.zeros(n, bool)
    wide[a[b - a >= 3]] = True

    word_line = np.searchsorted(end, w.start)
    per = lambda mask: np.bincount(word_line[mask], minlength=len(row)) if len(row) else np.zeros(0, np.int64)
    size = w.end - w.start
    digit_at = np.flatnonzero(digit)
    digits_in = np.searchsorted(digit_at, w.end) - np.searchsorted(digit_at, w.start)
    has_letter, has_digit = digits_in < size, digits_in > 0  # a word has nothing but letters and digits
    order = np.lexsort((w.hash, word_line))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (word_line[order][1:] != word_line[order][:-1])
    again = np.zeros(len(order), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (word_line[1:] == word_line[:-1])
    tail = last - (close[last] & (last > first))
    counts = {
        "lines": np.ones(len(row), np.int64), "chars": count_shown[end] - count_shown[start], "words": np.bincount(word_line, minlength=len(row)) if len(row) else np.zeros(0, np.int64), "letters": dense(letter), "digits": rare(digit), "symbols": rare((flag & _SYMBOL) > 0),
        "ended": stop[tail], "stops": rare(stop & (space_after | np.append(close[1:], False)) & ~np.append(False, stop[:-1])), "common": per(_known(w.hash, flags[1])), "glue": per(_known(w.hash, flags[2])), "marks": mark,
        "commas": rare(codes == 44), "tight": rare(((codes == 44) | (codes == 59)) & ~space_after), "semicolons": rare(codes == 59), "colons": rare((codes == 58) & space_after),
        "bars": rare((codes == 0x7C) | (codes == 0x2502) | (codes == 0x2503)), "tabs": rare(codes == 9, first), "gaps": rare(wide, first), "slashes": rare((codes == 47) & (after == 47)),
        "dots": rare((codes == 46) & (after == 46)), "singles": per(size == 1), "lengthy": per(size > 20), "mixed": per(has_letter & has_digit), "distinct": np.bincount(word_line[order][fresh], minlength=len(row)) if len(row) else np.zeros(0, np.int64),
        "repeats": per(again), "short": count_shown[end] - count_shown[start] < 40,
    }
    _, lines, doc_of, number_of = site_lines.line_words(texts)
    owner = np.searchsorted(w.bounds, start, "right") - 1
    number = row - np.searchsorted(feed, w.bounds[:-1])[owner] if len(row) else row
    # the same lines by text and number; those without letters have no hash
    key, wanted = (owner << 32) + number, (doc_of << 32) + number_of
    at = np.searchsorted(key, wanted)
    hashes, worded = np.zeros(len(row), np.uint64), np.zeros(len(row), bool)
    hashes[at], worded[at] = lines, True
    return owner, number, counts, hashes, worded


def _lines(data: dict) -> dict:
    owner, number, counts, hashes, worded = line_counts(data["text"])
    once = site_lines.first_of_each(hashes, owner, number) & worded
    site_of = np.array(data["site"], dtype=np.int64)[owner]
    out = {"doc_id": np.array(data["doc_id"], dtype=np.int64)[owner], "site": site_of, "line_no": number.astype(np.int32), "line": pa.array(K.signed(hashes), mask=~worded), "once": once}
    return out | {c: v.astype(np.int32) for c, v in counts.items()}


def counted_lines(docs: DataFrame) -> DataFrame:
    """Every non-blank line: doc_id, site and line as hashes (a line without letters has a null one), line_no, once, ``COUNTS``."""
    rows = documents(docs.withColumn("site", F.xxhash64(site())), "doc_id", "site", "text").where("text is not null")
    return table(map_chunks(rows, "text", f"{site_lines.LINES}, " + ", ".join(f"{c} int" for c in COUNTS), _lines), "counted")


def ratios() -> dict[str, Column]:
    """The figures that are shares, 0 where there is nothing to share."""
    return {name: F.coalesce(F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 9), F.lit(0.0)) for name, (a, b) in RATIOS.items()}


def figures_of(docs: DataFrame, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, ``COUNTS`` and ``RATIOS`` of all documents, from lines without the ``wanted`` (site, line) recurring ones.

    The lines of a document lie together, so sums before the shuffle leave about one row for each document.
    """
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    kept = lines.join(wanted, ["site", "line"], "left_anti").select("doc_id", *COUNTS)
    none = documents(docs, "doc_id").select("doc_id", *(F.lit(0).alias(c) for c in COUNTS))  # documents without lines have figures too
    sums = kept.unionByName(none).groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in COUNTS))
    return sums.select("doc_id", *COUNTS, *(c.alias(name) for name, c in ratios().items()))


def document_figures(docs: DataFrame) -> DataFrame:
    """doc_id and all figures of each document, the recurring lines of its site aside."""
    lines = counted_lines(docs)
    return figures_of(docs, lines, site_lines.recurring_table(lines.where("line is not null"), docs))


def labelled(docs: DataFrame, lines: DataFrame, wanted: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, form of ``size`` real documents, the smallest hashes of ids first, as the rater sees them."""
    ids = documents(docs, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    skip = lines.join(F.broadcast(ids), "doc_id", "left_semi").join(wanted, ["site", "line"], "left_semi").groupBy("doc_id").agg(F.collect_set("line_no").alias("skip"))  # lines of ``size`` documents
    rows = documents(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").join(F.broadcast(skip), "doc_id", "left")
    return map_chunks(rows, "text", "doc_id long, form string", lambda data: {"doc_id": data["doc_id"], "form": [form_labels.form(t, set(s or ())) for t, s in zip(data["text"], data["skip"])]})


def learn(figures: DataFrame, rated: DataFrame) -> list[rule_lists.Rule]:
    """The rule list from the figures of the rated documents, which are a bounded sample."""
    rows = figures.join(F.broadcast(rated), "doc_id").select("doc_id", "form", *RATIOS).toPandas().sort_values(["doc_id", "form"])
    x, y = {name: rows[name].to_numpy(float) for name in RATIOS}, rows["form"].to_numpy(str)
    if len(rows) < LEAST:
        more = form_labels.composed(LEAST - len(rows))
        own, filled = composed_ratios([text for text, _ in more]), np.array([form for _, form in more])
        x, y = {name: np.concatenate([x[name], own[name]]) for name in RATIOS}, np.concatenate([y, filled]) if len(rows) else filled
    return rule_lists.learn(x, y, FORMS)


def composed_ratios(texts: list[str]) -> dict[str, np.ndarray]:
    """``RATIOS`` of a few texts, without Spark."""
    owner, _, counts, _, _ = line_counts(texts)
    sums = {c: np.bincount(owner, weights=v, minlength=len(texts)) for c, v in counts.items()}
    return {name: np.round(sums[a] / np.maximum(sums[b], 1), 9) * (sums[b] > 0) for name, (a, b) in RATIOS.items()}


def forms(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, all figures and form: prose, list, table or junk."""
    lines = counted_lines(docs)
    wanted = site_lines.recurring_table(lines.where("line is not null"), docs)
    figures = table(figures_of(docs, lines, wanted), "figures")
    return figures.withColumn("form", F.expr(rule_lists.to_sql(learn(figures, labelled(docs, lines, wanted, size)), "prose")))


def latest_stats(stats: DataFrame) -> DataFrame:
    """The newest stored row of each document that has figures."""
    order = Window.partitionBy("doc_id").orderBy(F.col("analyzed_at").desc_nulls_last(), F.col("words").desc_nulls_last(), F.col("sentences").desc_nulls_last(), F.col("quality_score").desc_nulls_last())
    rows = documents(stats, "doc_id", "words", "sentences", "quality_score", "analyzed_at")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("doc_id", F.col("words").alias("stored_words"), F.col("sentences").alias("stored_sentences"), "quality_score")


def statistics(docs: DataFrame, stats: DataFrame) -> DataFrame:
    """The main figures of each document beside the words, sentences and quality_score last stored for it."""
    shown = ["doc_id", "lines", "chars", "words", F.col("stops").alias("sentences"), "mean_word", "symbol_share", "ended_lines", "common_words"]
    return document_figures(docs).select(*shown).join(latest_stats(stats), "doc_id", "left")
