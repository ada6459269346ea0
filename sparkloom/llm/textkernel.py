"""Vectorised text kernel shared by the training-data operators.

Texts arrive in Arrow batches. A chunk of them is laid end to end, turned into
one array of code points and reduced with numpy to words: their positions,
64-bit hashes, owner text and line. No Python code runs per word.

Normal form of a word: NFC, lower case (sharp s as ``ss``), format characters
deleted, every other character that is no letter, mark or digit a separator.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

#: Classes of characters.
SEP, LETTER, DIGIT, DROP = 0, 1, 2, 3

_LIMIT = 0x20000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_tables: tuple[np.ndarray, np.ndarray] | None = None
_powers: tuple[np.ndarray, np.ndarray] | None = None


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code and class of each code point below ``_LIMIT``; made once per process."""
    global _tables
    if _tables is None:
        lower = np.arange(_LIMIT, dtype=np.uint32)
        kind = np.zeros(_LIMIT, dtype=np.uint8)
        for code in range(_LIMIT):
            char = chr(code)
            category = unicodedata.category(char)
            if category[0] in "LM":
                kind[code] = LETTER
                low = char.lower()
                if len(low) == 1:
                    lower[code] = ord(low)
            elif category[0] == "N":
                kind[code] = DIGIT
            elif category == "Cf":
                kind[code] = DROP
        _tables = lower, kind
    return _tables


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with avalanche (the splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            up = np.full(size, _BASE, dtype=np.uint64)
            down = np.full(size, _BASE_INV, dtype=np.uint64)
            up[0] = down[0] = 1
            _powers = np.cumprod(up), np.cumprod(down)
    return _powers


@dataclass
class Words:
    """The words of a chunk of texts. ``start``/``end`` count in ``codes``; ``doc`` numbers texts from 0."""

    codes: np.ndarray
    kind: np.ndarray
    bounds: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def of(self, doc: int) -> slice:
        """The words of one text."""
        return slice(self.first[doc], self.first[doc + 1])

    def text(self, i: int) -> str:
        """A word in its normal form."""
        return self.codes[self.start[i] : self.end[i]].tobytes().decode("utf-32-le")


def prepare(text: str | None) -> str:
    """NFC with sharp s spelled out; None counts as empty."""
    if not text:
        return ""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "ß" in text or "ẞ" in text:
            text = text.replace("ß", "ss").replace("ẞ", "SS")
    return text


def code_points(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def words(texts: Sequence[str | None], *, digits: bool = True) -> Words:
    """Words of texts. Without ``digits`` digits are separators.

    >>> w = words(["Der Straße\\u200bn  nach, 7x", None, "a-b"])
    >>> [w.text(i) for i in range(len(w.hash))], w.doc.tolist()
    (['der', 'strassen', 'nach', '7x', 'a', 'b'], [0, 0, 0, 0, 2, 2])
    """
    lower, kinds = tables()
    parts = [prepare(t) for t in texts]
    bounds = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=bounds[1:])
    raw = code_points("\n".join(parts) + "\n") if parts else np.zeros(0, np.uint32)
    safe = np.minimum(raw, _LIMIT - 1)
    kind = kinds[safe]
    codes = np.where(raw < _LIMIT, lower[safe], raw)
    if len(raw) and raw.max() >= _LIMIT:
        kind[raw >= _LIMIT] = LETTER
    if (kind == DROP).any():
        keep = kind != DROP
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        codes, kind = codes[keep], kind[keep]
    inside = (kind == LETTER) | (kind == DIGIT) if digits else kind == LETTER
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(codes) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(codes.astype(np.uint64) * up[: len(codes)], out=total[1:])
        hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(len(parts)), np.diff(first))
    return Words(codes, kind, bounds, doc, start, end, hashes, first)


def grams(hashes: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words with one owner, and the index of each run's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            total = total * _BASE + hashes[i : i + n]
    at = np.flatnonzero(owner[:n] == owner[k - 1 :])
    return mix(total[at]), at


def chunks(texts: Sequence[str | None], size: int = 600_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``size`` characters each; a longer text stands alone, whole."""
    begin = held = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if held and held + n > size:
            yield begin, i
            begin, held = i, 0
        held += n + 1
    if held:
        yield begin, len(texts)


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's bigint."""
    return x.view(np.int64)
