"""Problem 6: items over a size limit cut at natural boundaries.

Method: pointer doubling. Every position is joined to its farthest legal successor: the start of the next
piece, which repeats the overlap. Squaring the table of successors yields all greedy cuts of a text in a
number of rounds that grows with the logarithm of its pieces.

A cut falls after a blank line, else a line, a sentence, a word, within the last half of the limit; where there
is none, at the limit. Sizes count code points. Null, empty and short texts come out as no piece (``split_long``)
and a text without any boundary is cut hard; nothing is dropped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textkernel as K
from sparkloom.llm.base import documents, map_chunks

LIMIT = 4096
OVERLAP = 200
#: How much shorter the repeated part may be in order to start at a boundary.
SLACK = 60
SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x3000], np.uint32)
STOPS = np.array([ord(c) for c in ".!?…。！？"], np.uint32)


def boundaries(codes: np.ndarray) -> list[np.ndarray]:
    """Masks over positions 0..n, best kind first: a piece may end before a marked position."""
    n = len(codes)
    space = np.isin(codes, SPACES)
    feed = codes == 10
    inner = ~space & np.concatenate([[False], space[:-1]]) if n else space
    word = np.concatenate([inner, [True]])
    since = np.cumsum(feed)
    begin = np.flatnonzero(word)
    ends = np.concatenate([[0], np.flatnonzero(~space) + 1])
    before = ends[np.searchsorted(ends, begin, "right") - 1] if n else begin  # end of the word before
    before = np.where(begin == before, ends[np.maximum(np.searchsorted(ends, begin, "left") - 1, 0)], before)
    total = np.concatenate([[0], since])
    feeds = total[begin] - total[before]
    stop = np.isin(codes[np.maximum(before - 1, 0)], STOPS) if n else np.zeros(len(begin), bool)
    masks = []
    for chosen in (feeds >= 2, feeds >= 1, stop):
        mask = np.zeros(n + 1, bool)
        mask[begin[chosen]] = True
        masks.append(mask)
    return [*masks, word]


def successors(codes: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """End of the piece that starts at each position, and the start of the next piece; the length is its own successor."""
    n = len(codes)
    at = np.arange(n + 1)
    masks = boundaries(codes)
    far = np.minimum(at + limit, n)
    end = np.where(far == n, n, -1)
    for mask in masks:
        last = np.maximum.accumulate(np.where(mask, at, -1))[far]
        end = np.where((end < 0) & (last > at + max(limit // 2, overlap)), last, end)
    end = np.where(end < 0, far, end)
    following = np.full(n + 1, n + 1)
    marked = np.flatnonzero(masks[3])
    following[: marked[-1] + 1] = marked[np.searchsorted(marked, at[: marked[-1] + 1])]
    start = np.maximum(end - overlap, at + 1)
    near = following[np.minimum(start, n)]
    start = np.where(near <= np.minimum(start + min(SLACK, overlap), end), near, start)
    return end, np.where(end == n, n, start)


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of all pieces of a text.

    >>> [(a, b) for a, b in cuts("one two three four", limit=9, overlap=4)]
    [(0, 8), (4, 13), (9, 18)]
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be under limit")
    if not text:
        return []
    codes = K.code_points(text)
    end, jump = successors(codes, limit, overlap)
    n = len(codes)
    path = np.zeros(1, np.int64)
    while path[-1] < n:  # path holds 2**i cuts; jump leads 2**i cuts ahead
        path = np.concatenate([path, jump[path]])
        jump = jump[jump]
    path = path[: np.argmax(path == n)]
    return list(zip(path.tolist(), end[path].tolist()))


def _pieces(data: dict, limit: int, overlap: int) -> dict:
    out: dict[str, list] = {"doc_id": [], "piece": [], "begin": [], "finish": [], "text": []}
    for doc, text in zip(data["doc_id"], data["text"]):
        for i, (a, b) in enumerate(cuts(text, limit, overlap)):
            for name, value in zip(out, (doc, i, a, b, text[a:b])):
                out[name].append(value)
    return out


def split_long(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, piece, begin, finish, text of every piece of the texts over ``limit``, in order of ``piece``."""
    long = documents(docs, "doc_id", "text").where(F.length("text") > limit)
    return map_chunks(long, "text", "doc_id long, piece int, begin int, finish int, text string", lambda data: _pieces(data, limit, overlap))
