"""Problem 10: the subjects that each document is about.

Method: normalised vectors of all documents are clustered by bisecting k-means. Leaves are labelled by their
discriminative terms, whose subjects the raters' labels give; each document's mixture of leaves then yields its subjects.

Vocabulary, frequencies, centres, labels and mixtures are sums over all documents: words are counted once and kept, tasks add
up what they read, and the driver gets sums of the vocabulary's size by leaf. Documents of the form ``junk`` (``text_forms``) and those with a null or empty text have no subject. Repeated,
contradictory and null labels only weaken each other. Without any label the words of ``subjects.covers`` stand in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import text_forms
from sparkloom.llm import textkernel as K
from sparkloom.llm.base import documents
from sparkloom.shared import table

LEAVES = 96
SMALLEST = 6
#: A term of the vocabulary stands in at least so many documents and this part of them, and in at most another part.
TERM_DOCUMENTS, TERM_LEAST, TERM_PART = 4, 0.001, 0.25
#: How often the documents of a leaf that is split move to the nearer centre.
MOVED = 1
#: A subject with this part of a document's mixture is one of its subjects.
PART = 0.15
ROUNDS = 12
#: Weight of the terms that a subject's other leaves lend to each of its leaves.
LENT = 3.0
#: How often the leaves are labelled anew with the mixtures they gave.
REFINED = 2


@dataclass
class Counted:
    """Terms of some documents and how often each has them, from ``first`` on; the subjects that raters set, as numbers, none for most."""

    ids: np.ndarray
    term: np.ndarray
    number: np.ndarray
    first: np.ndarray
    rated: list

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), np.diff(self.first))


@dataclass
class Fitted:
    """Weights of the terms, the term distribution of each leaf, and each leaf's subjects."""

    weight: np.ndarray
    leaf_terms: np.ndarray
    leaf_subjects: np.ndarray
    names: list[str]

    def mixtures(self, rows: Counted) -> np.ndarray:
        """Part of each subject in each text, by expectation maximisation over the leaves; zero rows for texts without terms."""
        out = np.zeros((len(rows.first) - 1, len(self.names)))
        for i, (a, b) in enumerate(zip(rows.first[:-1].tolist(), rows.first[1:].tolist())):
            if a == b:
                continue
            p = self.leaf_terms[rows.term[a:b]]
            n = rows.number[a:b] * self.weight[rows.term[a:b]]
            part = np.full(p.shape[1], 1 / p.shape[1], p.dtype)
            for _ in range(ROUNDS):
                part = part * ((n / (p @ part + 1e-12)).astype(p.dtype) @ p)
                part /= part.sum()
            out[i] = part @ self.leaf_subjects
        return out


@dataclass
class Tree:
    """Bisections of documents: a document goes to the right child of a node if its vector is on the right side of the node's direction."""

    weight: np.ndarray
    directions: list
    children: list  # (left, right) of each node, or none

    def vectors(self, rows: Counted) -> np.ndarray:
        """Weighted terms of unit vectors."""
        x, doc = np.log1p(rows.number) * self.weight[rows.term], rows.doc
        return x / np.maximum(np.sqrt(np.bincount(doc, x * x, len(rows.ids))), 1e-9)[doc]

    def leaves(self, rows: Counted, x: np.ndarray) -> np.ndarray:
        """The leaf of each document, as a number of a node."""
        node, doc = np.zeros(len(rows.ids), np.int64), rows.doc
        if not self.directions:
            return node
        table = np.stack([d for d in self.directions if d is not None] or [np.zeros(len(self.weight), np.float32)])
        inner = np.array([c is not None for c in self.children])
        row = np.cumsum(inner) - 1
        left, right = (np.array([c[k] if c else 0 for c in self.children]) for k in (0, 1))
        term = rows.term
        while (more := inner[node]).any():
            of = np.flatnonzero(more[doc])
            score = np.bincount(doc[of], x[of] * table[row[node[doc[of]]], term[of]], len(node))
            node[more] = np.where(score > 0, right[node], left[node])[more]
        return node


def bisect(x: np.ndarray, leaves: int = LEAVES, smallest: int = SMALLEST, seed: int = 1) -> np.ndarray:
    """Leaf of each row of unit vectors in memory: the leaf with the largest spread is split in two by spherical 2-means."""
    rng = np.random.default_rng(seed)
    leaf = np.zeros(len(x), np.int64)
    spread = {0: _spread(x)}
    while len(spread) < leaves and max(spread.values(), default=0) > 0:
        k = max(spread, key=lambda i: spread[i])
        rows = np.flatnonzero(leaf == k)
        side = _halve(x[rows], rng)
        if min(side.sum(), (~side).sum()) < smallest:
            spread[k] = 0.0
            continue
        new = len(spread)
        leaf[rows[side]] = new
        spread[k], spread[new] = _spread(x[rows[~side]]), _spread(x[rows[side]])
    return leaf


def _spread(x: np.ndarray) -> float:
    """Sum of 1 - cosine to the centre."""
    return float(len(x) - np.linalg.norm(x.sum(0)))


def _halve(x: np.ndarray, rng: np.random.Generator, tries: int = 3) -> np.ndarray:
    best, chosen = -1.0, np.zeros(len(x), bool)
    for _ in range(tries):
        first = x[rng.integers(len(x))]
        second = x[np.argmin(x @ first)]
        centres = np.stack([first, second])
        for _ in range(10):
            side = (x @ (centres[1] - centres[0])) > 0
            sums = np.stack([x[~side].sum(0), x[side].sum(0)])
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            if not norms.all():
                break
            centres = sums / norms
        good = float(np.linalg.norm(x[~side].sum(0)) + np.linalg.norm(x[side].sum(0)))
        if good > best:
            best, chosen = good, side
    return chosen


def counted(batch: pa.RecordBatch) -> Counted:
    lists = batch.column("terms")
    first = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)
    return Counted(batch.column("doc_id").to_numpy(), flat("terms").astype(np.int64), flat("numbers").astype(np.int64), first, batch.column("subjects").to_pylist())


def summed(rows: DataFrame, width: int, add: Callable[[Counted], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> dict[int, np.ndarray]:
    """Sums over all documents by key: ``add`` gives keys, places under ``width`` and values. Tasks add up first, then all tasks by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, at, value in add(counted(batch)):
                keys, which = np.unique(key, return_inverse=True)
                sums = np.bincount(which * width + at, value, len(keys) * width).reshape(-1, width)
                for k, v in zip(keys.tolist(), sums):
                    held[k] = held[k] + v if k in held else v
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["key", "sums"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for v in table["sums"]:
            total += np.frombuffer(v.as_buffer())
        return pa.table({"key": table["key"].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    few = rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)  # sums are as large for few documents as for many
    found = few.mapInArrow(run, "key int, sums binary").groupBy("key").applyInArrow(merge, "key int, sums binary").collect()
    return {r.key: np.frombuffer(r.sums) for r in found}


def bisected(rows: DataFrame, weight: np.ndarray, frequency: np.ndarray, leaves: int = LEAVES, smallest: int = SMALLEST) -> Tree:
    """Bisecting k-means of all documents, all leaves with the largest spread at a time.

    A leaf is parted by the term that varies most in it, then the documents go to the nearer of the two centres, ``MOVED`` times.
    """
    tree, width = Tree(weight, [None], [None]), len(weight) + 1

    def sums() -> dict[int, np.ndarray]:
        def add(own: Counted) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            x = tree.vectors(own)
            node = tree.leaves(own, x)
            yield node[own.doc], own.term, x
            yield node, np.full(len(node), width - 1), np.ones(len(node))

        return summed(rows, width, add)

    def spread(v: np.ndarray) -> float:
        """Sum of 1 - cosine to the centre."""
        return float(v[-1] - np.linalg.norm(v[:-1]))

    stats = sums()
    usual = stats.get(0, np.zeros(width))[:-1] / np.maximum(frequency, 1)  # weight of a term in a document that has it
    closed: set[int] = set()
    while True:
        room = leaves - len(stats)
        split = sorted((k for k, v in stats.items() if k not in closed and v[-1] >= 2 * smallest and spread(v) > 1e-9), key=lambda k: -spread(stats[k]))[: max(0, room)]
        if not split or not len(weight):
            return tree
        before = dict(stats)
        for k in split:
            mean = stats[k][:-1] / stats[k][-1]
            t = int(np.argmax(mean * np.maximum(0, usual - mean)))
            tree.directions[k] = (np.arange(len(weight)) == t).astype(np.float32)
            tree.children[k] = (len(tree.children), len(tree.children) + 1)
            tree.children += [None, None]
            tree.directions += [None, None]
        for _ in range(MOVED):
            found = sums()
            for k in split:
                a, b = (found.get(c, np.zeros(width))[:-1] for c in tree.children[k])
                norms = np.linalg.norm(a), np.linalg.norm(b)
                if min(norms) > 0:
                    tree.directions[k] = (b / norms[1] - a / norms[0]).astype(np.float32)
        stats = sums()
        for k in split:  # no leaf of a few documents
            if any(stats.get(c, np.zeros(width))[-1] < smallest for c in tree.children[k]):
                for c in tree.children[k]:
                    stats.pop(c, None)
                tree.directions[k] = tree.children[k] = None
                stats[k] = before[k]
                closed.add(k)


def counts(docs: DataFrame, rated: DataFrame, junk: DataFrame | None) -> DataFrame:
    """doc_id, words (hashes), numbers, subjects of every document that is to be assigned: all but ``junk``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in K.chunks(texts):
                w = K.words(texts[a:b], digits=False)
                order = np.lexsort((w.hash, w.doc))
                word, doc = w.hash[order], w.doc[order]
                new = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])])) if len(word) else np.zeros(0, np.int64)
                first = pa.array(np.searchsorted(doc[new], np.arange(b - a + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(first, pa.array(x)) for x in (K.signed(word[new]), np.diff(np.append(new, len(word))).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), *lists], names=["doc_id", "words", "numbers"])

    rows = documents(docs, "doc_id", "text").where("text is not null").mapInArrow(run, "doc_id long, words array<long>, numbers array<int>")
    rows = rows if junk is None else rows.join(junk, "doc_id", "left_anti")
    return rows.join(rated, "doc_id", "left")


def vocabulary(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Terms of all documents in the order of their hash, the documents that have them, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n = np.unique(batch.column("words").flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], names=["word", "n"])

    n = rows.count()
    least = max(n * TERM_LEAST, min(TERM_DOCUMENTS, max(1, n // 50)))
    found = rows.select("words").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= least) & (F.col("n") <= max(least, TERM_PART * n))).collect()
    words, frequency = np.array([r.word for r in found], np.int64).view(np.uint64), np.array([r.n for r in found], np.int64)
    order = np.argsort(words)
    return words[order], frequency[order], n


def termed(rows: DataFrame, terms: np.ndarray) -> DataFrame:
    """doc_id, terms (places in the vocabulary), numbers, subjects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            first = np.concatenate([[0], np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            word, number = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64), batch.column("numbers").flatten().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(terms, word), max(0, len(terms) - 1))
            known = terms[at] == word if len(terms) else np.zeros(len(word), bool)
            begin = pa.array(np.concatenate([[0], np.cumsum(known)])[first].astype(np.int32))
            lists = [pa.ListArray.from_arrays(begin, pa.array(x[known].astype(np.int32))) for x in (at, number)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists, batch.column("subjects")], names=["doc_id", "terms", "numbers", "subjects"])

    return rows.mapInArrow(run, "doc_id long, terms array<int>, numbers array<int>, subjects array<int>")


def fit(rows: DataFrame, terms: np.ndarray, frequency: np.ndarray, n: int, names: list[str], covers: list[str]) -> Fitted:
    """Clusters of all documents of ``rows`` labelled by the subjects that raters set for some; every sum is over all of them."""
    weight = np.log(n / np.maximum(frequency, 1)) if len(terms) else np.ones(0)
    tree = bisected(rows, weight, frequency)
    nodes = [k for k, c in enumerate(tree.children) if c is None]
    leaf_of = np.zeros(len(tree.children), np.int64)
    leaf_of[nodes] = np.arange(len(nodes))
    hint = np.zeros((len(terms), len(names)))
    if rows.where("size(subjects) > 0").isEmpty():
        w = K.words(covers, digits=False)
        at = np.minimum(np.searchsorted(terms, w.hash), max(0, len(terms) - 1))
        known = terms[at] == w.hash if len(terms) else np.zeros(len(at), bool)
        hint[at[known], w.doc[known]] = 1
    hinted, v, most = bool(hint.any()), len(terms), len(names)

    def sums(fitted: Fitted | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms by leaf, subjects by leaf, terms by subject."""

        def add(own: Counted) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            doc, number = own.doc, np.minimum(own.number, 5)
            y = np.zeros((len(own.ids), most))
            for i, told in enumerate(own.rated):
                for name in told or ():
                    y[i, name] = 1
            if hinted:
                for k in range(most):
                    y[:, k] = np.bincount(doc, hint[own.term, k] * own.number, len(y))
            y /= np.maximum(y.sum(1, keepdims=True), 1)
            if fitted:  # texts without a label, and subjects the raters left out, join in by their mixture
                mixed = fitted.mixtures(own)
                mixed = np.where(mixed >= PART, mixed, 0)
                y = np.where(y.sum(1, keepdims=True) > 0, (y + mixed) / 2, mixed)
            leaf = leaf_of[tree.leaves(own, tree.vectors(own))]
            yield leaf[doc], own.term, number
            i, k = np.nonzero(y)
            yield leaf[i], v + k, y[i, k]
            for k in range(most):
                yield np.full(len(doc), -1 - k), own.term, y[doc, k] * number

        found = summed(rows, v + most, add)
        of = lambda k: found.get(k, np.zeros(v + most))
        leaves = np.stack([of(k) for k in range(len(nodes)) if of(k)[:v].any()] or [np.zeros(v + most)])
        return leaves[:, :v].T, leaves[:, v:], np.stack([of(-1 - k)[:v] for k in range(most)], axis=1) if most else np.zeros((v, 0))

    one = Fitted(np.ones(v), np.zeros((v, 1)), np.zeros((1, most)), names)
    fitted = _parted(one, *sums(None))
    for _ in range(REFINED):
        fitted = _parted(one, *sums(fitted))
    return fitted


def _parted(one: Fitted, raw: np.ndarray, direct: np.ndarray, subject_terms: np.ndarray) -> Fitted:
    """Leaves parted by subject, from sums of terms by leaf, subjects by leaf and terms by subject."""
    names, count = one.names, raw.shape[1]
    prior = subject_terms.sum(0) / max(subject_terms.sum(), 1e-9)
    posterior = (subject_terms + 0.5 * prior) / (subject_terms.sum(1, keepdims=True) + 0.5)  # of a subject given a term
    sharp = 1 - _entropy(posterior) / np.log(max(2, len(names)))  # how much a term tells about the subject
    seen = subject_terms.sum(1)
    sharp = np.clip(sharp, 0, 1) * seen / (seen + 2)  # a term seen once or twice tells little
    # each leaf is parted by subject: its terms, weighted by what they tell, go to the subjects they speak for
    parts, subjects = [], []
    for k in range(count):
        vote = (raw[:, k] * sharp**2) @ posterior
        vote = vote / max(vote.sum(), 1e-9) + direct[k] / max(direct[k].sum(), 1)
        for s in np.flatnonzero(vote >= 0.12 * vote.sum()):
            parts.append(raw[:, k] * posterior[:, s])
            subjects.append(s)
    leaf_terms = np.stack(parts, axis=1) if parts else np.zeros((len(raw), 1))
    if parts:  # a small leaf knows few terms of its subject: the subject's other leaves lend it theirs
        leaf_terms /= np.maximum(leaf_terms.sum(0), 1e-9)
        pooled = np.stack([raw.sum(1) * posterior[:, s] for s in range(len(names))], axis=1)
        leaf_terms += LENT * (pooled / np.maximum(pooled.sum(0), 1e-9))[:, subjects]
        leaf_terms *= raw.sum() / max(1, count)
    leaf_terms = (leaf_terms + 1e-3) / (leaf_terms + 1e-3).sum(0)
    leaf_subjects = np.eye(len(names))[subjects] if parts else np.zeros((1, len(names)))
    return Fitted(sharp**2, leaf_terms.astype(np.float32), leaf_subjects, names)


def _entropy(p: np.ndarray) -> np.ndarray:
    return -(p * np.log(np.maximum(p, 1e-12))).sum(1)


def label_sets(labels: DataFrame, names: list[str]) -> DataFrame:
    """doc_id, subjects: the known subjects that raters set, each once."""
    rows = documents(labels, "doc_id", "subject").withColumn("subject", F.lower(F.trim("subject"))).where(F.col("subject").isin(names))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("subjects"))  # at most one of each name


def subjects_of(docs: DataFrame, labels: DataFrame, subjects: DataFrame, part: float = PART, junk: DataFrame | None = None) -> DataFrame:
    """doc_id, subject, part of the mixture, for every subject of every document of ``docs`` but those of ``junk``."""
    known = sorted((r.subject.strip().lower(), r.covers or "") for r in subjects.where("subject is not null").select("subject", "covers").collect())
    names = [name for name, _ in known]
    rated = label_sets(labels, names).select("doc_id", F.transform("subjects", lambda x: (F.array_position(F.array(*[F.lit(n) for n in names]).cast("array<string>"), x) - 1).cast("int")).alias("subjects"))
    words = table(counts(docs, rated, junk), "words")
    terms, frequency, n = vocabulary(words)
    rows = table(termed(words, terms), "terms")
    fitted = fit(rows, terms, frequency, n, names, [c for _, c in known])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = counted(batch)
            mixed = fitted.mixtures(own)
            doc, subject = np.nonzero(mixed >= part)
            yield pa.RecordBatch.from_arrays([pa.array(own.ids[doc], pa.int64()), pa.array([names[k] for k in subject], pa.string()), pa.array(mixed[doc, subject])], names=["doc_id", "subject", "part"])

    return rows.mapInArrow(assign, "doc_id long, subject string, part double")


def document_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """``subjects_of`` all documents but those of the form ``junk``. Only ids and counts of words are joined with those; no text moves."""
    return subjects_of(docs, labels, subjects, junk=text_forms.forms(docs).where("form = 'junk'").select("doc_id"))
