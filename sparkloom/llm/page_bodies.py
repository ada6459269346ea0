"""Problem 5: the main body of web pages without menus, notices, side columns and footers.

Method: a recurrent block labeller. Each non-blank line of a page is a block; its features are a path of structure
(what would be the path of tags: marker, case, ending, length, position) and a vector of hashed words. A bidirectional
LSTM in numpy reads the blocks of the whole page in both directions and classifies each of them.

The network is trained in the driver on ``TRAINING_PAGES`` pages, chosen by a hash of their id, whose blocks are labelled
by ``label``: votes of rules of which none sees more than a few neighbouring lines. All pages are read whole. A null or
blank text has no blocks; repeated pages come out alike; null titles are no feature; an empty table gives no rows.
"""

from __future__ import annotations

import io
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textkernel as K
from sparkloom.llm.base import documents, map_chunks

#: Pages that the network is trained on.
TRAINING_PAGES = 1000
HIDDEN, BUCKETS, STEPS, BATCH, RATE = 20, 512, 400, 24, 0.01

_MARK = re.compile(r"([-•*‣–])\s+(?=\S)|(\(?\d{1,3}[.)])\s+(?=\S)")
_DATE = re.compile(r"\b\d{4}[-/.]\d\d[-/.]\d\d\b|\b\d\d?[./]\d\d?[./]\d{4}\b")
_STOP = re.compile(r"[.!?…]+[\"”’)]*\s")
_ENDED = re.compile(r"[.!?][\"”’)]*$")
_SUFFIX = re.compile(r"\s+(?:\||–|—|-|::|·|»)\s+[^|–—·»:]{2,40}$")
_NAME = re.compile(r"\b[A-ZÀ-Þ]\w*|\d+")
_TRAIL = re.compile(r"\S\s+(?:›|>|»|/)\s+\S")

FEATURES = 30


def blocks(text: str | None) -> tuple[list[str], list[int], list[bool]]:
    """Stripped non-blank lines, their numbers, and whether a blank line stands before."""
    lines, numbers, gaps, gap = [], [], [], False
    for i, raw in enumerate((text or "").split("\n")):
        line = raw.strip(" \t\r\xa0​﻿")
        if line:
            lines.append(line)
            numbers.append(i)
            gaps.append(gap)
            gap = False
        else:
            gap = True
    return lines, numbers, gaps


def plain_title(title: str | None) -> str:
    """The title without the site's name, in lower case."""
    return _SUFFIX.sub("", title.strip()).strip().lower() if title else ""


def structure(lines: list[str], title: str | None) -> np.ndarray:
    """Features of the path of each block."""
    n = len(lines)
    out = np.zeros((n, FEATURES), np.float32)
    head, whole = plain_title(title), (title or "").strip().lower()
    for i, line in enumerate(lines):
        mark = _MARK.match(line)
        size, words = len(line), line.count(" ") + 1
        ended, stops = bool(_ENDED.search(line)), len(_STOP.findall(line))
        row = out[i]
        row[0] = 1
        row[1] = bool(mark and mark[1])
        row[2] = bool(mark and mark[2])
        row[3] = line[0] == "|" and line[-1] == "|"
        row[4] = line.count(" | ") > 0 and not row[3]
        row[5] = "·" in line
        row[6] = "  " in line
        row[7] = "—" in line or " – " in line
        row[8] = bool(_DATE.search(line))
        row[9] = ended
        row[10] = min(stops, 4) / 4
        row[11] = line.endswith(("…", "..."))
        row[12] = line.endswith(":")
        row[13] = "©" in line
        row[14] = bool(_TRAIL.search(line))
        row[15] = bool(head) and line.lower() in (head, whole)
        row[16] = words <= 1
        row[17] = words <= 3
        row[18] = 40 < size <= 90
        row[19] = size > 90
        row[20] = min(size, 600) / 600
        row[21] = line.isupper()
        row[22] = sum(c.isdigit() for c in line) / size
        row[23] = line[0].islower()
        row[24] = i / n
        row[25] = (n - 1 - i) / n
        row[26] = i < 3
        row[27] = n - i <= 3
        row[28] = ": " in line
        row[29] = ended and size > 60 and not mark and "—" not in line
    return out


def encode(texts: list[list[str]], titles: list[str | None]) -> np.ndarray:
    """Features of all blocks of some pages, one row each: structure and hashed words, weighted to unit length."""
    path = np.concatenate([structure(x, t) for x, t in zip(texts, titles)] or [np.zeros((0, FEATURES), np.float32)])
    flat = [line for lines in texts for line in lines]
    w = K.words(flat, digits=False)
    words = np.zeros((len(flat), BUCKETS), np.float32)
    np.add.at(words, (w.doc, (w.hash % np.uint64(BUCKETS)).astype(np.int64)), 1)
    words /= np.maximum(np.sqrt((words**2).sum(1, keepdims=True)), 1)
    return np.concatenate([path, words], axis=1)


# ---- labels of the training pages ---------------------------------------------------------------------------------


def _frame(line: str) -> str:
    """A line without names, numbers and marks."""
    return " ".join((line if line.isupper() else _NAME.sub(" ", line)).lower().split())


def label(pages: list[tuple[list[str], str | None]]) -> list[np.ndarray]:
    """1 for blocks of the main body, 0 for others, from votes of rules about a block and its neighbours.

    A block whose wording recurs on other pages is a notice. The body begins at the headline, or at the first paragraph
    where none is found, and ends with the last paragraph; short lines within it count if a paragraph, list or table follows.
    """
    recurring = Counter(f for lines, _ in pages for f in {_frame(x) for x in lines})
    labels = []
    for lines, title in pages:
        n = len(lines)
        head, whole = plain_title(title), (title or "").strip().lower()
        frames = [recurring[_frame(x)] for x in lines]
        marked = [bool(_MARK.match(x)) for x in lines]
        table = [x[0] == "|" and x[-1] == "|" and len(x) > 3 for x in lines]
        paragraph = [bool(_ENDED.search(x)) and len(x) > 45 and not marked[i] and not table[i] and " — " not in x and "©" not in x and frames[i] <= 2 for i, x in enumerate(lines)]
        y = np.zeros(n, np.float32)
        if any(paragraph):
            first, last = paragraph.index(True), n - 1 - paragraph[::-1].index(True)
            titled = [i for i, x in enumerate(lines[: first + 1]) if x.lower() in (head, whole) and head]
            byline = lambda x: bool(_DATE.search(x)) or "|" in x or "·" in x
            start = titled[-1] if titled else first
            if not titled:
                at = first - 1
                while at >= 0 and (byline(lines[at]) or frames[at] > 8):
                    at -= 1
                if at >= 0 and not marked[at] and not table[at] and 12 < len(lines[at]) < 110 and lines[at].count(" ") >= 2 and frames[at] <= 8 and not _TRAIL.search(lines[at]):
                    start = at
            stop = last
            while stop + 1 < n and (marked[stop + 1] or table[stop + 1]):
                stop += 1
            body = [False] * n
            for i in range(start, stop + 1):
                x = lines[i]
                if paragraph[i] or table[i] or (marked[i] and (frames[i] <= 40 or x.count(" ") >= 2)) or (i == start and start < first):
                    body[i] = True
            for i in range(start + 1, stop):
                x = lines[i]
                if body[i] or marked[i] or table[i] or byline(x) or " — " in x or x.endswith("…") or len(x) > 110:
                    continue
                known = x.count(" ") == 0 and frames[i] > 30 and not x.endswith(":")
                promo = (frames[i] > 6 and len(_frame(x).split()) >= 5) or bool(re.match(r"[^:]{4,24} ?: \S", x) and recurring[_frame(x)] >= 1 and _RECOMMENDS.match(x)) or _ENDED.search(x)
                before = body[i - 1] or byline(lines[i - 1]) or bool(_RECOMMENDS.match(lines[i - 1])) or frames[i - 1] > 40
                if body[i + 1] and before and not known and not promo and not _BOX.match(x):
                    body[i] = True
            y[:] = body
        labels.append(y)
    return labels


# What introduces a link to another page, and what stands over boxes of such links or of tags.
_RECOMMENDS = re.compile(r"(?:read (?:also|more|next)|see also|more on this|related|lire aussi|à lire|lisez aussi|lesen sie|auch interessant|mehr dazu|lea también|ver también|más sobre)\b[^:]{0,20}:", re.IGNORECASE)
_BOX = re.compile(r"(?:tags?|related entries|related|popular now|most read(?: this week)?|you may also like|editor's picks|more in this section|in this section|read more|latest|mots-clés|à lire aussi|les plus lus|sur le même sujet|meistgelesen|schlagworte|das könnte sie auch interessieren|mehr zum thema|etiquetas|lo más leído|sobre el mismo tema|también le puede interesar)\W*$", re.IGNORECASE)


# ---- the network --------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class BiLstm:
    """Bidirectional LSTM with a logistic output for each step of a sequence."""

    def __init__(self, size: int, hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for way in "fb":
            self.p[f"x{way}"] = rng.normal(0, 1 / np.sqrt(FEATURES), (size, 4 * hidden)).astype(np.float32)
            self.p[f"h{way}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
            self.p[f"b{way}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)
        self.p["o"] = rng.normal(0, 1 / np.sqrt(2 * hidden), 2 * hidden).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def _run(self, z: np.ndarray, way: str, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """States of one direction over time-major inputs; masked steps keep the state."""
        steps, batch, _ = z.shape
        n = self.hidden
        h, c = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
        out, kept = np.zeros((steps, batch, n), np.float32), []
        for t in range(steps):
            a = z[t] + h @ self.p[f"h{way}"]
            gates = _sigmoid(a[:, : 3 * n])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            g = np.tanh(a[:, 3 * n :])
            m = mask[t][:, None]
            fresh = f * c + i * g
            now = m * fresh + (1 - m) * c
            th = np.tanh(fresh)
            kept.append((i, f, o, g, c, th, h))
            h, c = m * (o * th) + (1 - m) * h, now
            out[t] = h
        return out, kept

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Log-odds of all steps. ``x``: steps, batch, features, aligned at the first step."""
        steps, batch, _ = x.shape
        flat = x.reshape(steps * batch, -1)
        size = mask.sum(0).astype(int)
        flip = np.where(np.arange(steps)[:, None] < size, size - 1 - np.arange(steps)[:, None], np.arange(steps)[:, None])
        col = np.arange(batch)
        zf = (flat @ self.p["xf"] + self.p["bf"]).reshape(steps, batch, -1)
        zb = (flat @ self.p["xb"] + self.p["bb"]).reshape(steps, batch, -1)[flip, col]
        hf, kf = self._run(zf, "f", mask)
        hb, kb = self._run(zb, "b", mask)
        both = np.concatenate([hf, hb[flip, col]], axis=2)
        return both @ self.p["o"] + self.p["c"], (x, mask, flip, col, kf, kb, both)

    def _back(self, way: str, kept: list, mask: np.ndarray, dout: np.ndarray, grads: dict) -> np.ndarray:
        steps, batch, n = dout.shape
        dz = np.zeros((steps, batch, 4 * n), np.float32)
        dh, dc = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
        for t in reversed(range(steps)):
            i, f, o, g, c, th, h = kept[t]
            m = mask[t][:, None]
            total = dh + dout[t]
            dhm = total * m
            dfresh = m * dc + dhm * o * (1 - th**2)
            da = dz[t]
            da[:, :n] = dfresh * g * i * (1 - i)
            da[:, n : 2 * n] = dfresh * c * f * (1 - f)
            da[:, 2 * n : 3 * n] = dhm * th * o * (1 - o)
            da[:, 3 * n :] = dfresh * i * (1 - g**2)
            grads[f"h{way}"] += h.T @ da
            dh = da @ self.p[f"h{way}"].T + total * (1 - m)
            dc = dfresh * f + dc * (1 - m)
        return dz

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        logits, (x, mask, flip, col, kf, kb, both) = self.forward(x, mask)
        d = (_sigmoid(logits) - y) * mask / mask.sum()
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["o"], grads["c"] = np.tensordot(d, both, ([0, 1], [0, 1])).astype(np.float32), np.array([d.sum()], np.float32)
        dboth = d[:, :, None] * self.p["o"]
        n = self.hidden
        flat = x.reshape(-1, x.shape[2])
        for way, kept, dout in (("f", kf, dboth[:, :, :n]), ("b", kb, dboth[flip, col, n:])):
            dz = self._back(way, kept, mask, dout, grads)
            if way == "b":
                dz = dz[flip, col]
            grads[f"b{way}"] = dz.sum((0, 1))
            grads[f"x{way}"] = flat.T @ dz.reshape(len(flat), -1)
        return grads

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 5) -> BiLstm:
        """Adam over ``steps`` batches."""
        if not pages:
            return self
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        queue: list[int] = []
        for step in range(1, steps + 1):
            while len(queue) < min(batch, len(pages)):
                queue += rng.permutation(len(pages)).tolist()
            chosen, queue = queue[:batch], queue[batch:]
            x, mask = pad([pages[i] for i in chosen])
            y = np.zeros(mask.shape, np.float32)
            for j, i in enumerate(chosen):
                y[: len(labels[i]), j] = labels[i]
            grads = self.gradients(x, mask, y)
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            scale = min(1.0, 2.0 / max(norm, 1e-9))
            pace = rate * (1 - step / (steps + 1))
            for k, g in grads.items():
                g = g * scale
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g**2
                self.p[k] -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self


def to_bytes(network: BiLstm) -> bytes:
    """The weights of a network, to be kept and loaded instead of training anew."""
    out = io.BytesIO()
    np.savez(out, **network.p)
    return out.getvalue()


def from_bytes(data: bytes) -> BiLstm:
    """The network of ``to_bytes``; bytes of anything else are an error."""
    with np.load(io.BytesIO(data), allow_pickle=False) as found:
        weights = {k: found[k] for k in found.files}
    network = BiLstm(len(weights["xf"]), weights["o"].size // 2)
    if {k: v.shape for k, v in weights.items()} != {k: v.shape for k, v in network.p.items()}:
        raise ValueError("no weights of such a network")
    network.p = weights
    return network


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Time-major inputs and mask of sequences of different length."""
    steps = max(1, max(map(len, pages), default=1))
    x = np.zeros((steps, len(pages), pages[0].shape[1] if pages else 1), np.float32)
    mask = np.zeros((steps, len(pages)), np.float32)
    for j, page in enumerate(pages):
        x[: len(page), j] = page
        mask[: len(page), j] = 1
    return x, mask


def train(rows: list[tuple[str | None, str | None]]) -> BiLstm:
    """A network for (text, title) rows labelled by ``label``."""
    pages = [(blocks(text)[0], title) for text, title in rows]
    pages = [(lines, title) for lines, title in pages if lines]
    encoded = [encode([lines], [title]) for lines, title in pages]
    return BiLstm(FEATURES + BUCKETS).fit(encoded, label(pages))


class Labeller:
    """The trained network, sent to every task."""

    def __init__(self, network: BiLstm):
        self.network = network

    def logits(self, texts: list[list[str]], titles: list[str | None]) -> list[np.ndarray]:
        """Log-odds of each block, page by page; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(texts)
        order = sorted((i for i in range(len(texts)) if texts[i]), key=lambda i: len(texts[i]))
        at = 0
        while at < len(order):
            count, longest = 1, len(texts[order[at]])
            while at + count < len(order) and (count + 1) * (longest := len(texts[order[at + count]])) <= 3000:
                count += 1
            some = order[at : at + count]
            flat = encode([texts[i] for i in some], [titles[i] for i in some])
            ends = np.cumsum([len(texts[i]) for i in some])
            found, _ = self.network.forward(*pad(np.split(flat, ends[:-1])))
            for j, i in enumerate(some):
                out[i] = found[: len(texts[i]), j]
            at += count
        return out

    def __call__(self, data: dict) -> dict:
        cut = [blocks(t) for t in data["text"]]
        found = self.logits([c[0] for c in cut], data["title"])
        rows: dict[str, list] = {"page_id": [], "line_no": []}
        for page, (_, numbers, _), score in zip(data["page_id"], cut, found):
            chosen = [number for number, s in zip(numbers, score.tolist()) if s > 0]
            rows["page_id"] += [page] * len(chosen)
            rows["line_no"] += chosen
        return rows


def training_rows(pages: DataFrame, count: int = TRAINING_PAGES) -> list[tuple[str | None, str | None]]:
    """Text and title of the ``count`` pages with the smallest hash of their id."""
    rows = documents(pages, "page_id", "title", "text").where("text is not null")
    ids = rows.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(count).distinct()  # ids alone, so that no partition sends its texts
    chosen = rows.join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.min(F.struct("text", "title")).alias("r")).select("page_id", "r.*").collect()
    return [(r.text, r.title) for r in sorted(chosen, key=lambda r: r.page_id)]


def main_bodies(pages: DataFrame, network: BiLstm | None = None) -> DataFrame:
    """page_id, line_no of every line of the main body of each page; ``network`` (of ``train`` or ``from_bytes``) spares the training."""
    labeller = Labeller(network or train(training_rows(pages)))
    rows = documents(pages, "page_id", "title", "text").where("text is not null")
    return map_chunks(rows, "text", "page_id long, line_no int", labeller, size=300_000)
