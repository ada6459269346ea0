"""Problem 8: passages of test items inside documents.

Method: winnowing. Of the hashes of ``GRAM``-word runs in each window of ``WINDOW`` runs the smallest is kept,
so that a shared span of GRAM + WINDOW - 1 = 12 words always has a fingerprint on both sides. Fingerprints of
documents are joined with those of the items, and each hit is extended to the whole shared span.

Up to ``ITEM_WORDS`` words of items go to every task as a sorted table; more items are joined by a shuffle of the
fingerprints. Both ways give the same rows. Null ids and texts have no passages; repeated items count by item_id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textkernel as K
from sparkloom.llm.base import documents, map_chunks

PASSAGE = 12
GRAM = 6
WINDOW = PASSAGE - GRAM + 1
#: Words of items that are sent to every task (8 MB); beyond it the fingerprints are joined by a shuffle.
ITEM_WORDS = 1_000_000
SALTS = 16


def fingerprints(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes and the index of the first word of each; the rightmost of equal ones is kept."""
    g, at = K.grams(w.hash, w.doc, GRAM)
    if len(g) < WINDOW:
        return g, at
    m = len(g) - WINDOW + 1
    best, least = np.zeros(m, np.int64), g[:m].copy()
    for i in range(1, WINDOW):
        lower = g[i : i + m] <= least
        best[lower] = i
        least = np.where(lower, g[i : i + m], least)
    whole = w.doc[at[:m]] == w.doc[at[WINDOW - 1 :]]
    keep = np.unique((np.arange(m) + best)[whole])
    return g[keep], at[keep]


def extend(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> np.ndarray:
    """Length of the longest common run through words i of a and j of b, up to ``PASSAGE`` words on either side."""
    run = np.zeros(len(i), np.int64)
    on = np.ones(len(i), bool)
    for k in range(PASSAGE):
        on &= (i + k < end_a) & (j + k < end_b)
        on[on] = a[i[on] + k] == b[j[on] + k]
        run += on
    on = run > 0
    for k in range(1, PASSAGE):
        on &= (i - k >= first_a) & (j - k >= first_b)
        on[on] = a[i[on] - k] == b[j[on] - k]
        run += on
    return run


class Items:
    """Words and sorted fingerprints of test items, sent to every task."""

    def __init__(self, ids: list, texts: list):
        w = K.words(texts)
        self.words, self.ids = w.hash, np.array(ids, dtype=np.int64)
        prints, at = fingerprints(w)
        order = np.argsort(prints, kind="stable")
        self.prints, self.at = prints[order], at[order]
        self.doc = w.doc[self.at]
        self.first, self.end = w.first[self.doc], w.first[self.doc + 1]

    def __call__(self, data: dict) -> dict:
        w = K.words(data["text"])
        prints, at = fingerprints(w)
        low, high = np.searchsorted(self.prints, prints, "left"), np.searchsorted(self.prints, prints, "right")
        count = high - low
        hit = np.repeat(at, count)
        item = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(count) else np.zeros(0, np.int64)
        doc = w.doc[hit]
        run = extend(w.hash, self.words, hit, self.at[item], w.first[doc + 1], self.end[item], w.first[doc], self.first[item])
        good = run >= PASSAGE
        pairs = np.unique(np.stack([doc[good], self.doc[item[good]]]), axis=1)
        return {"doc_id": np.array(data["doc_id"], dtype=np.int64)[pairs[0]], "item_id": self.ids[pairs[1]]}


def _prints(data: dict) -> dict:
    w = K.words(data["text"])
    prints, at = fingerprints(w)
    return {"id": np.array(data["id"], dtype=np.int64)[w.doc[at]], "print": K.signed(prints)}


def _check(data: dict) -> dict:
    keep = []
    for text, item in zip(data["text"], data["item"]):
        w = K.words([text, item])
        g, at = K.grams(w.hash, w.doc, PASSAGE)
        side = w.doc[at]
        keep.append(bool(np.isin(g[side == 0], g[side == 1]).any()))
    return {"doc_id": [x for x, k in zip(data["doc_id"], keep) if k], "item_id": [x for x, k in zip(data["item_id"], keep) if k]}


def leaks(docs: DataFrame, items: DataFrame, item_words: int = ITEM_WORDS) -> DataFrame:
    """doc_id, item_id of documents that hold at least ``PASSAGE`` consecutive words of the item."""
    texts, tests = documents(docs, "doc_id", "text").where("text is not null"), documents(items, "item_id", "text").where("text is not null")
    size = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    if size <= 2 * item_words:  # a word and its separator take two characters at least, so this bounds the words
        rows = tests.collect()
        return map_chunks(texts, "text", "doc_id long, item_id long", Items([r.item_id for r in rows], [r.text for r in rows])).distinct()
    left = map_chunks(texts.withColumnRenamed("doc_id", "id"), "text", "id long, print long", _prints).withColumnRenamed("id", "doc_id")
    right = map_chunks(tests.withColumnRenamed("item_id", "id"), "text", "id long, print long", _prints).withColumnRenamed("id", "item_id")
    # a passage that much of the corpus holds is met in ``SALTS`` parts; the items, the smaller side, are repeated for each
    left = left.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    right = right.distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = left.join(right, ["print", "salt"]).select("doc_id", "item_id").distinct()
    both = pairs.join(texts, "doc_id").join(tests.withColumnRenamed("text", "item"), "item_id")
    return map_chunks(both, "text", "doc_id long, item_id long", _check).distinct()
