"""Problem 3: near-duplicate documents.

Method: bottom-k sketches from one hash function over the distinct runs of three words. Inverted lists of
retained values generate overlaps: short lists are paired by a join. Longer ones than ``LONG_LIST`` are followed by an exact
prefix filter: classes with enough retained values in long lists are read in shards, and each is held against those that share
enough of the rarest. The sketch of the union estimates the similarity of each candidate; exact Jaccard similarity of the whole
sets decides. Only the estimates can lose a pair, and none of two sets of up to ``RETAINED`` runs.

Texts with the same set of word runs are one class; only classes are compared, and members are added at the
end. Null ids and texts of under three words have no pairs; repeated rows of one id are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textkernel as K
from sparkloom.llm.base import BROADCAST_ROWS, documents, map_chunks
from sparkloom.shared import new_path, table

RUN = 3
SIMILARITY = 0.5
RETAINED = 32
#: Longer inverted lists are followed in shards, rarest first.
LONG_LIST = 16
#: Values whose upper halves estimate the similarity of a candidate: the inverted lists need few, a close estimate more.
ESTIMATED = 64
#: Standard deviations under the similarity sought that an estimate may lie.
DEVIATIONS = 2.8
#: Sketches of fewer values need one shared list only, others two.
SMALL = 12
#: Values of long lists that must be shared among the rarest. More make longer lists to follow, but fewer pairs to estimate.
SHARED = 5
SHARD = 20_000
#: Classes that a task holds at most, about.
TASK = 50_000
#: Entries of inverted lists followed, and counters of pairs held, at a time.
HITS, COUNTERS = 1_000_000, 2_000_000


def least_estimate(similarity: float, values: int) -> float:
    """What the estimate from a sketch of ``values`` must reach.

    >>> round(least_estimate(0.5, 64), 3), round(least_estimate(0.5, 32), 2)
    (0.325, 0.25)
    """
    return max(0.0, similarity - DEVIATIONS * (similarity * (1 - similarity) / values) ** 0.5)


def runs_by_text(texts: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``k``-word runs in ascending order, text by text, and where each text's begin."""
    w = K.words(texts)
    g, at = K.grams(w.hash, w.doc, k)
    doc = w.doc[at]
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    if len(g):
        keep = np.concatenate([[True], (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])])
        g, doc = g[keep], doc[keep]
    return g, np.searchsorted(doc, np.arange(len(texts) + 1))


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(K.signed(values)))


def _classes(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The class of each text: the same for the same set of runs."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(g + np.uint64(1)))])
        return K.signed(K.mix((sums[first[1:]] - sums[first[:-1]]) ^ np.diff(first).astype(np.uint64)))


def _sketch(data: dict) -> dict:
    g, first = runs_by_text(data["text"], RUN)
    total = np.diff(first)

    def smallest(most: int) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.concatenate([[0], np.cumsum(np.minimum(total, most))])
        at = np.repeat(first[:-1] - offsets[:-1], np.diff(offsets)) + np.arange(offsets[-1])
        return g[at] ^ np.uint64(1 << 63), offsets  # in the same order as signed numbers

    upper, offsets = smallest(ESTIMATED)
    upper = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array((K.signed(upper) >> 32).astype(np.int32)))
    return {"doc_id": data["doc_id"], "class": _classes(g, first), "size": total.astype(np.int32), "kept": _lists(*smallest(RETAINED)), "upper": upper}


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, class (same for the same set of runs), size of the set, kept (its smallest hashes), upper (the upper halves of more of them)."""
    rows = documents(docs, "doc_id", "text").where("text is not null")
    return map_chunks(rows, "text", "doc_id long, class long, size int, kept array<long>, upper array<int>", _sketch).where("size > 0")


def _pairs(lists: DataFrame) -> DataFrame:
    """Pairs within lists (key, class, small)."""
    a = lists.select("key", F.col("class").alias("a"), F.col("small").alias("small_a"))
    b = lists.select("key", F.col("class").alias("b"), F.col("small").alias("small_b"))
    return a.join(b, "key").where("a < b").select("a", "b", (F.col("small_a") | F.col("small_b")).alias("small"))


def _rows(classes: DataFrame) -> DataFrame:
    """class, size, small, k1 (a retained value), n (classes in its list) of all lists of several classes."""
    rows = classes.select("class", "size", (F.col("size") < SMALL).alias("small"), F.explode("kept").alias("k1"))
    counted = rows.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return table(rows.join(counted, "k1"), "lists")


def candidates(rows: DataFrame) -> DataFrame:
    """Pairs of classes that share retained values of short lists: two, or one where a set is small."""
    found = _pairs(rows.where(F.col("n") <= LONG_LIST).select(F.col("k1").alias("key"), "class", "small"))
    return found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("hits"), F.max("small").alias("small")).where("hits > 1 or small").select("a", "b")


class Shard:
    """Inverted lists of the rarest values that some classes have in long lists, each in the order of the size of the sets."""

    def __init__(self, rows: pa.Table, similarity: float = SIMILARITY):
        rows = rows.sort_by([("size", "ascending"), ("class", "ascending")])
        self.similarity = similarity
        self.id, self.size, self.need = (rows[c].to_numpy().astype(np.int64) for c in ("class", "size", "need"))
        self.upper = _padded(rows["upper"].combine_chunks())
        value, row = _rarest(rows)
        order = np.lexsort((row, value))
        self.values, which = np.unique(value[order], return_inverse=True)
        self.row = row[order]
        self.key = (which << 32) + self.row

    def scan(self, other: Shard) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (a < b) of classes of ``other`` and of the shard that share enough values and whose estimate is likely.

        The class of the shard has the larger set, or an equally large one and the larger id, so each pair comes from one side; no
        set can be alike that is more than 1 / ``similarity`` times as large.
        """
        if not len(self.values) or not len(other.values):
            return
        low = np.searchsorted(self.size, other.size)  # the rows of the shard that each class may be alike
        high = np.searchsorted(self.size, (other.size / self.similarity + 1e-9).astype(np.int64), "right")
        order = np.argsort(other.row, kind="stable")
        row, value = other.row[order], other.values[other.key[order] >> 32]
        at = np.minimum(np.searchsorted(self.values, value), len(self.values) - 1)
        there = self.values[at] == value
        at, row = at[there], row[there]
        first = np.searchsorted(self.key, (at << 32) + low[row])
        count = np.maximum(0, np.searchsorted(self.key, (at << 32) + high[row]) - first)
        total = np.concatenate([[0], np.cumsum(count)])
        mine = np.searchsorted(row, np.arange(len(other.id) + 1))
        until, begin = total[mine], 0
        while begin < len(other.id):
            width = max(1, int(high[begin : begin + 256].max() - low[begin]))  # sizes ascend, so ranges of neighbours are alike
            end = max(begin + 1, min(begin + 256, len(other.id), begin + max(1, COUNTERS // width), int(np.searchsorted(until, until[begin] + HITS, "right")) - 1))
            a, b = mine[begin], mine[end]
            if total[b] > total[a]:
                place = np.repeat(first[a:b] - total[a:b], count[a:b]) + np.arange(total[a], total[b])
                hits = np.bincount(np.repeat((row[a:b] - begin) * width - low[begin], count[a:b]) + self.row[place])
                found = np.flatnonzero(hits >= min(SHARED, other.need[begin:end].min()))
                x, y = found // width + begin, found % width + low[begin]
                keep = hits[found] >= np.minimum(SHARED, np.maximum(other.need[x], self.need[y]))
                keep &= (self.size[y] > other.size[x]) | (self.id[y] > other.id[x])
                x, y = x[keep], y[keep]
                for c in range(0, len(x), 20_000):
                    u, v = x[c : c + 20_000], y[c : c + 20_000]
                    good = likely(other.upper[u], self.upper[v], self.similarity)
                    p, q = other.id[u[good]], self.id[v[good]]
                    yield np.minimum(p, q), np.maximum(p, q)
            begin = end


def _padded(upper: pa.Array) -> np.ndarray:
    size = upper.value_lengths().to_numpy()
    out = np.full((len(size), ESTIMATED), np.iinfo(np.int32).max, np.int32)
    out[np.arange(ESTIMATED) < size[:, None]] = upper.flatten().to_numpy()
    return out


def _rarest(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The values of each row among whose first ones ``SHARED`` are shared if ``need`` are shared at all, and their rows."""
    values = rows["values"].combine_chunks()
    size = values.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    use = place < (size - np.maximum(0, rows["need"].to_numpy() - SHARED))[row]
    return values.flatten().to_numpy()[use], row[use]


def likely(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Whether the sketches of the unions of pairs of padded sketches give an estimate that a pair of ``similarity`` may have."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    real = both < np.iinfo(np.int32).max
    again = np.zeros(both.shape, bool)
    again[:, 1:] = both[:, 1:] == both[:, :-1]
    inside = real & (np.cumsum(~again, axis=1, dtype=np.int16) <= ESTIMATED)
    return (again & inside).sum(axis=1) >= least_estimate(similarity, ESTIMATED) * (~again & inside).sum(axis=1)


def _read(path: str) -> pa.Table:
    where = path if "://" in path else f"file://{path}"
    system, folder = fs.FileSystem.from_uri(where.replace("s3a://", "s3://").replace("file:////", "file:///"))
    return pq.read_table(folder, filesystem=system, columns=["class", "size", "need", "values", "upper"], partitioning=None)


def _scanner(folders: list[tuple[str, int, int]], similarity: float):
    """``folders``: path, smallest and largest set of each shard."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # sketches only
        if not held:
            return
        rows = Shard(pa.Table.from_batches(held), similarity)
        least, most = int(rows.size[0]), int(rows.size[-1])
        for folder, smallest, largest in folders:
            if largest >= least and smallest <= most / similarity + 1e-9:
                for pair in Shard(_read(folder), similarity).scan(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pair], schema=schema)

    return run


def long_list_pairs(rows: DataFrame, classes: DataFrame, similarity: float = SIMILARITY, shard: int = SHARD) -> DataFrame:
    """Pairs of classes whose estimate is likely and of whose shared values at most one is in a short list.

    Sketches whose estimate is likely share that part of the larger one at least; where the other set must have a whole
    sketch too, ``similarity`` holds instead. One less is needed here, as two of short lists are found there.
    """
    spark = rows.sparkSession
    least = F.when(F.col("size") <= RETAINED * similarity, F.ceil(F.col("size") * similarity - 1e-9)).otherwise(F.floor(F.least("size", F.lit(RETAINED)) * least_estimate(similarity, RETAINED)))
    values = rows.where(F.col("n") > LONG_LIST).groupBy("class").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("n", "k1"))).alias("v"))
    values = values.select("class", "size", F.greatest(F.lit(1), least - 1).cast("int").alias("need"), F.col("v.k1").alias("values")).where("size(values) >= need")
    found = table(values.join(classes.select("class", "upper"), "class"), "long")
    path = new_path(spark, "shards")
    count = found.count()
    shards = max(1, -(-count // shard))
    found.repartitionByRange(shards, "size", "class").withColumn("shard", F.spark_partition_id()).write.partitionBy("shard").parquet(path)
    there = spark.read.schema(f"{_LONG}, shard int").parquet(path).groupBy("shard").agg(F.min("size").alias("least"), F.max("size").alias("most")).orderBy("shard").collect()  # a row for each shard
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-count // TASK))  # a task reads the shards of sets that may be alike its own, so tasks are few and long
    return found.repartitionByRange(tasks, "size", "class").mapInArrow(_scanner([(f"{path}/shard={r.shard}", r.least, r.most) for r in there], similarity), "a long, b long")


_LONG = "class long, size int, need int, values array<long>, upper array<int>"


def _runs(data: dict) -> dict:
    g, first = runs_by_text(data["text"], RUN)
    same = (_classes(g, first) == np.array(data["class"], dtype=np.int64)).tolist()  # another text under the same id is left out
    return {"class": [c if s else None for c, s in zip(data["class"], same)], "runs": _lists(g, first)}


def class_pairs(docs: DataFrame, sketched: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a, b, similarity of all pairs of classes at or over ``similarity``."""
    classes = table(sketched.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("kept").alias("kept"), F.first("upper").alias("upper")), "classes")
    side = lambda x: classes.select(F.col("class").alias(x), F.col("upper").alias(f"upper_{x}"))
    union = F.slice(F.array_sort(F.array_union("upper_a", "upper_b")), 1, ESTIMATED)
    both = F.array_intersect(union, F.array_intersect("upper_a", "upper_b"))
    rows = _rows(classes)
    few = candidates(rows).join(side("a"), "a").join(side("b"), "b").where(F.size(both) >= least_estimate(similarity, ESTIMATED) * F.size(union)).select("a", "b")
    likely = table(few.unionByName(long_list_pairs(rows, classes, similarity)).distinct(), "likely")
    wanted = table(likely.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(classes.select("class", "doc_id"), "class"), "wanted")
    if wanted.count() <= BROADCAST_ROWS:  # texts stay where they are; beyond it Spark filters them by the ids before they move
        wanted = F.broadcast(wanted)
    texts = documents(docs, "doc_id", "text").join(wanted, "doc_id")
    runs = table(map_chunks(texts.select("class", "text"), "text", "class long, runs array<long>", _runs).where("class is not null"), "runs")
    side = lambda x: runs.select(F.col("class").alias(x), F.col("runs").alias(f"runs_{x}"))
    shared = F.size(F.array_intersect("runs_a", "runs_b"))

    both = likely.join(side("a"), "a").join(side("b"), "b").withColumn("shared", shared)
    return both.select("a", "b", (F.col("shared") / (F.size("runs_a") + F.size("runs_b") - F.col("shared"))).alias("similarity")).where(F.col("similarity") >= similarity).distinct()  # a text stored twice under its id gives its pairs twice


def near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_a, doc_b of all pairs at or over ``similarity``."""
    sketched = table(sketches(docs), "sketches")
    members = sketched.select("class", "doc_id").distinct()
    pairs = table(class_pairs(docs, sketched, similarity), "pairs")
    first, second = members.select(F.col("class").alias("a"), F.col("doc_id").alias("x")), members.select(F.col("class").alias("b"), F.col("doc_id").alias("y"))
    across = pairs.join(first, "a").join(second, "b").select("x", "y")
    within = first.join(second.withColumnRenamed("b", "a"), "a").where("x < y").select("x", "y")
    return across.unionByName(within).where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def grouped(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, group_id (the smallest id of the group), links (other texts that its text is a near copy of) for every document.

    Copies are not expanded into pairs. A document without word runs, or without near copies, is a group of its own.
    """
    sketched = table(sketches(docs), "sketches")
    found = groups(table(class_pairs(docs, sketched, similarity), "pairs"), sketched.select("class", "doc_id").distinct())
    ids = documents(docs, "doc_id").distinct()
    return ids.join(found, "doc_id", "left").select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """doc_id, group_id (smallest id of the group), links (of its class) for every document, copies not expanded.

    ``pairs`` (a, b) link classes; ``members`` has class and doc_id. Components come from alternating large-star and
    small-star steps over written edges, whose number of rounds grows with the logarithm of the largest group.
    """
    edges = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    links = edges.select(F.explode(F.array("u", "v")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    before = None
    while True:
        # large star: every larger neighbour points to the smallest of the neighbourhood
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours and the node itself point to the smallest of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = table(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    root = members.join(edges.select(F.col("u").alias("class"), F.col("v").alias("root")), "class", "left").join(links, "class", "left").withColumn("root", F.coalesce("root", "class"))
    ids = root.groupBy("root").agg(F.min("doc_id").alias("group_id"))
    return root.join(ids, "root").select("doc_id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))
