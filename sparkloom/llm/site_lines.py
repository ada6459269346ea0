"""Problem 2: lines repeated across the documents of one site.

Method: line counts are kept as tables by site (``LineCounts``, a named folder). A new batch of documents is counted alone, its
counts are merged into the stored ones as a delta, the lines that cross the threshold, upwards or downwards, are found by
comparison with those known before, and only documents that hold such a line, or are new and hold a recurring one, are rebuilt.
A batch is known by its id: delivered again, it changes nothing.

Null ids are left out; a null text has no lines; a repeated row counts as a document of its own once for each row; an
empty table gives empty results. Extra columns don't matter.
"""

from __future__ import annotations

from fractions import Fraction
from urllib.parse import quote, unquote

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import textkernel as K
from sparkloom.llm.base import BROADCAST_ROWS, documents, map_chunks, site
from sparkloom.shared import mark, names, new_path, remove, table

MIN_DOCUMENTS = 5
MIN_SHARE = 0.1
LINES = "doc_id long, site long, line_no int, line long, once boolean"
COUNTS, TOTALS, KEYS = "site long, line long, holding long", "site long, documents long", "site long, line long"


def line_words(texts: list) -> tuple[K.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of letters only; hash, text and number of each line with words."""
    w = K.words(texts, digits=False)
    feeds = np.concatenate([[0], np.cumsum(w.codes == 10)])
    row = feeds[w.start]
    new = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    up, down = K.powers(len(row) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * up[: len(row)])])
        end = np.append(new[1:], len(row))
        lines = K.mix((total[end] - total[new]) * down[new]) if len(new) else np.zeros(0, np.uint64)
    doc = w.doc[new]
    return w, lines, doc, row[new] - feeds[w.bounds[doc]]


def first_of_each(lines: np.ndarray, doc: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Whether a line is the first of its wording in its text."""
    once = np.zeros(len(lines), bool)
    order = np.lexsort((number, lines, doc))
    once[order] = np.concatenate([[True], (np.diff(doc[order]) != 0) | (lines[order][1:] != lines[order][:-1])]) if len(order) else True
    return once


def _lines(data: dict) -> dict:
    _, lines, doc, number = line_words(data["text"])
    once = first_of_each(lines, doc, number)
    return {"doc_id": np.array(data["doc_id"])[doc], "site": np.array(data["site"])[doc], "line_no": number.astype(np.int32), "line": K.signed(lines), "once": once}


def _sited(docs: DataFrame) -> DataFrame:
    return documents(docs.withColumn("site", F.xxhash64(site())), "doc_id", "site", "text")


def site_lines(docs: DataFrame) -> DataFrame:
    """Every line with letters: site and line as 64-bit hashes; ``once`` marks a line's first occurrence in its document."""
    return map_chunks(_sited(docs), "text", LINES, _lines)


def site_totals(docs: DataFrame) -> DataFrame:
    """Documents by site. A site with a third of all rows is summed up before the shuffle."""
    return documents(docs.withColumn("site", F.xxhash64(site())), "doc_id", "site").groupBy("site").agg(F.count(F.lit(1)).alias("documents"))


def line_delta(lines: DataFrame) -> DataFrame:
    """Documents by site and line."""
    return lines.where("once").groupBy("site", "line").agg(F.count(F.lit(1)).alias("holding"))


def merge_counts(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """Stored counts and those of a new batch, added up by all columns but the last."""
    *keys, value = stored.columns
    return stored.unionByName(delta).groupBy(*keys).agg(F.sum(value).alias(value))


def recurring(counts: DataFrame, totals: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float | str | Fraction = MIN_SHARE) -> DataFrame:
    """Lines in at least ``min_documents`` documents and in at least ``min_share``, as written in decimals, of all documents of the site."""
    share = Fraction(str(min_share))
    few = counts.where(F.col("holding") >= min_documents)
    return few.join(totals, "site").where(F.col("holding") * share.denominator >= F.col("documents") * share.numerator).select("site", "line")


def changed_lines(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lines that recur now and did not before, or no more."""
    return after.join(before, ["site", "line"], "left_anti").unionByName(before.join(after, ["site", "line"], "left_anti"))


def bounded(wanted: DataFrame) -> DataFrame:
    """``wanted``, to be broadcast if it has at most ``BROADCAST_ROWS`` rows; else joins shuffle it."""
    return F.broadcast(wanted) if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else wanted


def occurrences(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``lines`` that are wanted."""
    return lines.join(bounded(wanted), ["site", "line"], "left_semi")


def recurring_table(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """site, line of the recurring lines of one table, counted in one go."""
    return table(recurring(line_delta(lines), site_totals(docs)), "recurring")


class LineCounts:
    """Line counts by site in the folder ``path``, which grows batch by batch.

    ``counts``, ``totals`` and ``recurring`` are snapshots, one for each version; ``lines`` has a partition for each batch. A version
    is in force once the mark with its batch's id is there, so a job that fails in between leaves the former one as it was.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE):
        self.spark, self.path = spark, (path or new_path(spark, "line-counts")).rstrip("/")
        self.min_documents, self.min_share = min_documents, min_share

    def batches(self) -> list[str]:
        """Ids of the batches merged so far, in order: names of marks, one for each version."""
        return [unquote(name.split("-", 1)[1]) for name in names(self.spark, f"{self.path}/batches") if not name.startswith((".", "_"))]

    def _at(self, name: str, version: int, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/version={version}") if version else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str, version: int, schema: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/version={version}")
        return self._at(name, version, schema)

    def lines(self, version: int | None = None) -> DataFrame:
        """Lines of all batches merged up to ``version``; one folder, whatever their number."""
        version = len(self.batches()) if version is None else version
        if not version:
            return self.spark.createDataFrame([], LINES)
        rows = self.spark.read.option("basePath", f"{self.path}/lines").schema(f"{LINES}, version int").parquet(f"{self.path}/lines")
        return rows.where(F.col("version") <= version).drop("version")

    def recurring(self) -> DataFrame:
        return self._at("recurring", len(self.batches()), KEYS)

    def add(self, batch: str, docs: DataFrame) -> int:
        """Merge the documents of ``batch``; the version made, or that in which the batch was merged before."""
        known = self.batches()
        if batch in known:
            return known.index(batch) + 1
        version = len(known) + 1
        fresh = self._write(site_lines(docs), "lines", version, LINES)
        counts = self._write(merge_counts(self._at("counts", version - 1, COUNTS), line_delta(fresh)), "counts", version, COUNTS)
        totals = self._write(merge_counts(self._at("totals", version - 1, TOTALS), site_totals(docs)), "totals", version, TOTALS)
        self._write(recurring(counts, totals, self.min_documents, self.min_share), "recurring", version, KEYS)
        mark(self.spark, f"{self.path}/batches/{version:08d}-{quote(batch, safe='')}")
        for name in ("counts", "totals"):  # two versions back nothing reads them any more
            remove(self.spark, f"{self.path}/{name}/version={version - 2}")
        return version

    def touched(self, version: int) -> DataFrame:
        """doc_id of all documents to be rebuilt after ``version``: those that hold a line which crossed the threshold, and new ones with a recurring line."""
        now = self._at("recurring", version, KEYS)
        changed = table(changed_lines(self._at("recurring", version - 1, KEYS), now), "changed")
        old = self.lines(version - 1)
        return occurrences(old, changed).select("doc_id").unionByName(occurrences(self._at("lines", version, LINES), now).select("doc_id")).distinct()

    def found(self) -> DataFrame:
        """doc_id, line_no of every recurring line of all batches."""
        return occurrences(self.lines(), self.recurring()).select("doc_id", "line_no").distinct()


def by_arrival(docs: DataFrame, time: str = "collected_at") -> list[tuple[str, DataFrame]]:
    """``docs`` in two batches: what came in before the latest year, and what came in since or at an unknown time."""
    last = docs.agg(F.max(F.year(time))).first()[0]
    old = F.coalesce(F.year(time) < F.lit(last), F.lit(False))
    return [(f"before {last}", docs.where(old)), (f"since {last}", docs.where(~old))]


def repeated_lines(docs: DataFrame, batches: list[tuple[str, DataFrame]] | None = None) -> DataFrame:
    """doc_id, line_no of every recurring line, merged batch by batch; by default ``docs`` is one batch."""
    state = LineCounts(docs.sparkSession)
    for name, part in batches or [("all", docs)]:
        state.add(name, part)
    return state.found()


def _cut(text: str | None, gone: set[int]) -> str | None:
    return text if not gone or text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def _without(data: dict) -> dict:
    texts = [_cut(text, set(drop or ())) for text, drop in zip(data["text"], data["drop"])]
    return {"doc_id": data["doc_id"], "text": texts, "removed": [len(d or ()) if t is not None else 0 for d, t in zip(data["drop"], texts)]}


class Cutter:
    """Cuts recurring lines out of texts; the (site, line) keys are sent to every task, ``BROADCAST_ROWS`` at most."""

    def __init__(self, sites: np.ndarray, lines: np.ndarray):
        self.keys = np.unique(self._key(sites, lines))

    @staticmethod
    def _key(sites: np.ndarray, lines: np.ndarray) -> np.ndarray:
        return K.mix(sites.view(np.uint64) ^ K.mix(lines.view(np.uint64)))

    def __call__(self, data: dict) -> dict:
        _, lines, doc, number = line_words(data["text"])
        key = self._key(np.array(data["site"], dtype=np.int64)[doc], K.signed(lines))
        hit = np.isin(key, self.keys)
        gone: list[set[int]] = [set() for _ in data["text"]]
        for d, n in zip(doc[hit].tolist(), number[hit].tolist()):
            gone[d].add(n)
        return {"doc_id": data["doc_id"], "text": [_cut(t, g) for t, g in zip(data["text"], gone)], "removed": list(map(len, gone))}


def cleaned(docs: DataFrame, wanted: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """doc_id, text without the ``wanted`` (site, line) lines, removed. With ``only`` (doc_id) no other documents are rebuilt.

    No text moves where the wanted lines are few; beyond ``BROADCAST_ROWS`` line numbers are joined to texts by a shuffle.
    """
    rows = _sited(docs)
    if only is not None:
        rows = rows.join(bounded(only.select("doc_id").distinct()), "doc_id", "left_semi")
    few = wanted.select("site", "line").limit(BROADCAST_ROWS + 1).toPandas()
    if len(few) <= BROADCAST_ROWS:
        return map_chunks(rows, "text", "doc_id long, text string, removed int", Cutter(few["site"].to_numpy(np.int64), few["line"].to_numpy(np.int64)))
    return rebuild(rows, occurrences(map_chunks(rows, "text", LINES, _lines), wanted).select("doc_id", "line_no"))


def rebuild(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text without the lines in ``found`` (doc_id, line_no), removed."""
    drop = found.groupBy("doc_id").agg(F.collect_set("line_no").alias("drop"))  # bounded by the lines of one document
    return map_chunks(documents(docs, "doc_id", "text").join(drop, "doc_id", "left"), "text", "doc_id long, text string, removed int", _without)
