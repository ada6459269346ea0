"""Problem 7: records that stand in an evaluation split and in the training split.

Method: an exact prefix filter on words. The words of each record (the second "the" of a record is another word than
the first) are put in the order of how many evaluation records have them, rarest first; that order is counted once, by buckets of
hashes. Two texts that share enough words share ``SHARED`` of them among their first ones. Words of few records of a shard are
inverted lists, and every pair on one is looked at; pairs without such a word must share ``SHARED`` of the others, which are rows of
bits, so that one addition of bits counts for 64 records. That gives every pair that can be alike and few others.
What is alike enough is decided by the longest common subsequence of words, exactly.

Passages in an automaton (Aho–Corasick) cannot give these pairs: with three words in ten changed evenly no passage of more than
three words need be left, and of short records not even one of two, while passages of one word are such lists. What the automaton
would merge, the words matched in each record, is given as ``coverage`` all the same.

No pair is lost at any length, number of edits or size of a group of near copies. Before two texts are compared in full, the
words they share in any order bound what they can have in common. Shards hold records of one language and like length; they are read
from the shared folder, those of other lengths not at all, so no fingerprints pass through the driver. Equal evaluation records share one class; training rows are scanned each. Null ids are
left out; null messages and contents count as empty; records without words match nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import languages
from sparkloom.llm import textkernel as K
from sparkloom.llm.base import documents
from sparkloom.shared import new_path, table

ALIKE = 0.7
#: Words that must be shared among the first ones, 16 at most. More make more rows of bits to add, but fewer pairs to compare.
SHARED = 16
SHARD = 20_000
#: A word of at most one of so many records of a shard is a list of them, any other a row of bits.
FEW = 3_000
#: Evaluation records to a row of bits, and texts counted at a time: such counters stay in a processor's cache.
TILE, BLOCK = 4_096, 128
#: Bits of a hash by which words are put in the order of their frequency; the table of that is of fixed size.
BUCKETS = 20
#: Training records whose words a task holds, about; more make more tasks.
TASK = 50_000
#: Entries of inverted lists followed at a time.
HITS = 1_000_000
#: Bits of the numbered words of a text that bound what another can have in common with it.
BITS = 2048
#: Rounding of products with a share never loses a pair.
EPSILON = 1e-6


def contents(messages: str = "messages") -> Column:
    """Contents of all messages but those of the system, in order."""
    told = F.filter(F.coalesce(F.col(messages), F.array()), lambda m: F.coalesce(F.lower(F.trim(m["role"])), F.lit("")) != "system")
    return F.array_join(F.transform(told, lambda m: F.coalesce(m["content"], F.lit(""))), "\n")


def common_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, with the bits of an integer as one row of the table.

    >>> common_words([1, 2, 3, 4], [2, 9, 4, 3])
    2
    """
    where: dict[int, int] = defaultdict(int)
    for i, x in enumerate(b):
        where[x] |= 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def numbered(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes of words with their number among the equal words of their text, so that what two texts share is a set."""
    order = np.lexsort((words, owner))
    w, o = words[order], owner[order]
    at = np.arange(len(w))
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty_like(words)
    with np.errstate(over="ignore"):
        out[order] = K.mix(w + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def ordered(words: np.ndarray, first: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The numbered words of each text from the rarest to the commonest, by ``ranks`` of buckets of hashes; which are equal stays as it was."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found = numbered(words, owner)
    found = (ranks[found >> np.uint64(64 - BUCKETS)] << np.uint64(64 - BUCKETS)) | (found & np.uint64((1 << 64 - BUCKETS) - 1))
    return found[np.lexsort((found, owner))]


def marked(keys: np.ndarray, first: np.ndarray, block: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """A bit of ``BITS`` for each numbered word, in rows of 64-bit words, and how many words of each text have no bit of their own."""
    size = np.diff(first)
    bits = np.zeros((len(size), BITS // 64), np.uint64)
    for a in range(0, len(size), block):
        b = min(len(size), a + block)
        table = np.zeros((b - a, BITS), bool)
        table[np.repeat(np.arange(b - a), size[a:b]), (keys[first[a] : first[b]] % np.uint64(BITS)).astype(np.int64)] = True
        bits[a:b] = np.packbits(table, axis=1).view(np.uint64)
    return bits, size - np.bitwise_count(bits).sum(1, dtype=np.int64)


def firsts(keys: np.ndarray, first: np.ndarray, alike: float) -> tuple[np.ndarray, np.ndarray]:
    """Of words in order, the first ones of each text: of what it shares with a text alike, ``SHARED`` words (all, if fewer) are among them."""
    size = np.diff(first)
    n = np.minimum(size, np.floor((1 - alike) * size + EPSILON).astype(np.int64) + SHARED)
    begin = np.concatenate([[0], np.cumsum(n)])
    return keys[np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], n)], begin


def _enough(longer: np.ndarray, alike: float) -> np.ndarray:
    return np.minimum(SHARED, np.ceil(alike * longer - EPSILON)).astype(np.int64)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray, spare: list[np.ndarray]) -> None:
    """Add bits of ``b`` and ``c`` to ``a``: sums go to ``a``, what is carried to ``b``."""
    u, v = spare
    np.bitwise_xor(a, b, out=u)
    np.bitwise_and(a, b, out=v)
    np.bitwise_and(u, c, out=b)
    np.bitwise_or(b, v, out=b)
    np.bitwise_xor(u, c, out=a)


def _shared(rows: np.ndarray, which: np.ndarray, least: int) -> np.ndarray:
    """Bits of the records that have at least ``least`` (up to 16) of the words of each text; ``which``: rows of ``rows``, 8 or a multiple for each text."""
    shape = (len(which), rows.shape[1])
    x, spare = [np.empty(shape, np.uint64) for _ in range(8)], [np.empty(shape, np.uint64) for _ in range(2)]
    # counters start so that they run over at ``least``
    ones, twos, fours, eights = (np.full(shape, -(16 - least >> i & 1) & 0xFFFFFFFFFFFFFFFF, np.uint64) for i in range(4))
    over = np.zeros(shape, np.uint64)
    for k in range(0, which.shape[1], 8):
        for i in range(8):
            rows.take(which[:, k + i], axis=0, out=x[i], mode="clip")
        for i in (0, 2, 4, 6):
            _add(ones, x[i], x[i + 1], spare)
        for i in (0, 4):
            _add(twos, x[i], x[i + 2], spare)
        _add(fours, x[0], x[4], spare)
        np.bitwise_and(eights, x[0], out=spare[0])
        np.bitwise_or(over, spare[0], out=over)
        np.bitwise_xor(eights, x[0], out=eights)
    return over


class Texts:
    """Training texts in ascending order of their length: their words, and the first ones of them in the common order."""

    def __init__(self, words: np.ndarray, size: np.ndarray, ranks: np.ndarray, alike: float = ALIKE):
        self.size, self.words = size, words
        self.first = np.concatenate([[0], np.cumsum(size)])
        self.keys = ordered(words, self.first, ranks)
        self.bits, self.more = marked(self.keys, self.first)
        keys, self.begin = firsts(self.keys, self.first, alike)
        self.known, self.which = np.unique(keys, return_inverse=True)


class Shard:
    """Evaluation records by their first words: words of few records as lists, others as bits, ``TILE`` records in ascending order of length to a tile."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, keys: np.ndarray, first: np.ndarray, alike: float = ALIKE):
        order = np.argsort(np.diff(first), kind="stable")
        self.ids, self.alike, self.size = ids[order], alike, np.diff(first)[order]
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        at = np.arange(self.first[-1]) + np.repeat(first[:-1][order] - self.first[:-1], self.size)
        self.words, self.keys = words[at], keys[at]
        self.bits, self.more = marked(self.keys, self.first)
        keys, begin = firsts(self.keys, self.first, alike)
        record = np.repeat(np.arange(len(self.size)), np.diff(begin))
        self.known, which, count = np.unique(keys, return_inverse=True, return_counts=True)
        common = count > len(self.size) // FEW
        self.common = int(common.sum())
        #: Row of bits of a word, or -1 - n for the list n.
        self.place = np.where(common, np.cumsum(common) - 1, -np.cumsum(~common))
        self.rows = np.zeros((-(-len(self.size) // TILE), self.common + 1, TILE // 64), np.uint64)  # the last row has no bits
        at = np.flatnonzero(common[which])
        r = record[at]
        # a text has a word once, so that adding bits sets them
        np.add.at(self.rows, (r // TILE, self.place[which[at]], r % TILE // 64), np.uint64(1) << (r % 64).astype(np.uint64))
        at = np.flatnonzero(~common[which])
        at = at[np.argsort(-1 - self.place[which[at]], kind="stable")]
        self.listed, self.lists = record[at], np.concatenate([[0], np.cumsum(count[~common])])

    def scan(self, texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Texts and records of all pairs that share enough of their first words, a block of texts at a time; a pair can come twice."""
        if not len(self.known) or not len(texts.known):
            return
        at = np.minimum(np.searchsorted(self.known, texts.known), len(self.known) - 1)
        nowhere = self.common  # the row without bits
        place = np.where(self.known[at] == texts.known, self.place[at], nowhere)[texts.which]
        doc = np.repeat(np.arange(len(texts.size)), np.diff(texts.begin))
        yield from self._few(doc, place)
        many = (place >= 0) & (place < nowhere)
        place, doc = place[many], doc[many]
        begin = np.searchsorted(doc, np.arange(len(texts.size) + 1))
        count, need = np.diff(begin), _enough(texts.size, self.alike)
        for t, rows in enumerate(self.rows):
            least, most = self.size[t * TILE], self.size[min(len(self.size), (t + 1) * TILE) - 1]
            low, high = np.searchsorted(texts.size, [self.alike * least - EPSILON, most / self.alike + EPSILON])
            mine = np.arange(low, np.searchsorted(texts.size, most / self.alike + EPSILON, "right")) if high >= low else np.zeros(0, np.int64)
            mine = mine[(count[mine] >= np.maximum(need[mine], _enough(least, self.alike))) & (texts.size[mine] > 0)]
            for a in range(0, len(mine), BLOCK):
                d = mine[a : a + BLOCK]
                wide = -(-int(count[d].max()) // 8) * 8
                k = begin[d][:, None] + np.arange(wide)
                which = np.where(k < begin[d + 1][:, None], place[np.minimum(k, len(place) - 1)], nowhere)
                found = _shared(rows, which, int(max(need[d[0]], _enough(least, self.alike)))).ravel()
                hit = np.flatnonzero(found)
                if len(hit):
                    i, bit = np.nonzero(np.unpackbits(found[hit].view(np.uint8), bitorder="little").reshape(-1, 64))
                    yield d[hit[i] // rows.shape[1]], t * TILE + hit[i] % rows.shape[1] * 64 + bit

    def _few(self, doc: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that share a word of few records."""
        few = place < 0
        doc, place = doc[few], -1 - place[few]
        count = self.lists[place + 1] - self.lists[place]
        total = np.concatenate([[0], np.cumsum(count)])
        a = 0
        while a < len(doc):
            b = max(a + 1, int(np.searchsorted(total, total[a] + HITS, "right")) - 1)
            spot = np.repeat(self.lists[place[a:b]] - total[a:b], count[a:b]) + np.arange(total[a], total[b])
            yield np.repeat(doc[a:b], count[a:b]), self.listed[spot]
            a = b

    def possible(self, texts: Texts, doc: np.ndarray, record: np.ndarray, block: int = 50_000) -> np.ndarray:
        """Which pairs can be ``alike`` at all, by the bits of their words and their lengths. Loses no pair."""
        out = np.zeros(len(doc), bool)
        for a in range(0, len(doc), block):
            d, r = doc[a : a + block], record[a : a + block]
            need = self.alike * np.maximum(texts.size[d], self.size[r]) - EPSILON
            near = np.flatnonzero(np.minimum(texts.size[d], self.size[r]) >= need)
            d, r = d[near], r[near]
            shared = np.bitwise_count(texts.bits[d] & self.bits[r]).sum(1, dtype=np.int64) + np.minimum(texts.more[d], self.more[r])
            out[a + near[shared >= need[near]]] = True
        return out


def _rows(path: str, columns: list[str]) -> pa.Table:
    where = path if "://" in path else f"file://{path}"
    system, folder = fs.FileSystem.from_uri(where.replace("s3a://", "s3://").replace("file:////", "file:///"))
    return pq.read_table(folder, filesystem=system, columns=columns, partitioning=None)


def load_ranks(path: str) -> np.ndarray:
    """The place of each bucket of hashes in the order of how many words of evaluation records fall into it."""
    rows, counts = _rows(path, ["bucket", "n"]), np.zeros(1 << BUCKETS, np.int64)
    np.add.at(counts, rows["bucket"].to_numpy(), rows["n"].to_numpy())
    ranks = np.empty(1 << BUCKETS, np.uint64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(1 << BUCKETS, dtype=np.uint64)
    return ranks


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), first


def load_shard(path: str, alike: float = ALIKE) -> Shard:
    rows = _rows(path, ["class", "words", "keys"])
    words, first = _flat(rows["words"].combine_chunks())
    return Shard(rows["class"].to_numpy(), words, _flat(rows["keys"].combine_chunks())[0], first, alike)


def _scanner(shards: list[tuple[str, int, int]], ranked: str, alike: float):
    """``shards``: their folders with the fewest and the most words of a record in them."""
    schema = pa.schema([("train", pa.int64()), ("class", pa.int64()), ("coverage", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        parts, sizes = [], []
        for batch in batches:  # a partition is kept as its word hashes, 8 bytes a word
            texts = batch.column("text").to_pylist()
            ids = batch.column("record_id").to_numpy()
            for a, b in K.chunks(texts):
                w = K.words(texts[a:b])
                parts.append(w.hash)
                sizes.append(np.diff(w.first))
                held.append(ids[a:b])
        if not held:
            return
        words, size, ids = np.concatenate(parts), np.concatenate(sizes), np.concatenate(held)
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        order = np.argsort(size, kind="stable")  # in the order of their length
        ids, size = ids[order], size[order]
        words = words[np.arange(size.sum()) + np.repeat(begin[order] - (np.cumsum(size) - size), size)]
        texts = Texts(words, size, load_ranks(ranked), alike)

        def compared(shard: Shard, docs: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
            found: tuple[list, list, list] = ([], [], [])
            last, mine, own = -1, [], set()
            for d, r in zip(docs.tolist(), records.tolist()):
                a, b = int(size[d]), int(shard.size[r])
                if d != last:
                    of = slice(texts.first[d], texts.first[d + 1])
                    last, mine, own = d, words[of].tolist(), set(texts.keys[of].tolist())
                of = slice(shard.first[r], shard.first[r + 1])
                if len(own.intersection(shard.keys[of].tolist())) < alike * max(a, b) - EPSILON:  # in any order
                    continue
                common = common_words(mine, shard.words[of].tolist())
                if common >= alike * max(a, b):
                    for column, value in zip(found, (int(ids[d]), int(shard.ids[r]), common / max(a, b))):
                        column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(found, schema)], schema=schema)

        for folder, least, most in shards:
            if size[-1] < alike * least - EPSILON or size[0] > most / alike + EPSILON:
                continue
            shard = load_shard(folder, alike)
            for docs, records in shard.scan(texts):
                keep = shard.possible(texts, docs, records)
                if keep.any():
                    yield compared(shard, *np.divmod(np.unique(docs[keep] * len(shard.size) + records[keep]), len(shard.size)))

    return run


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("class", pa.int64()), ("lang", pa.string()), ("size", pa.int32()), ("words", pa.list_(pa.int64()))])
    for batch in batches:
        data = batch.to_pydict()
        for a, b in K.chunks(data["text"]):
            w = K.words(data["text"][a:b])
            lists = pa.ListArray.from_arrays(pa.array(w.first.astype(np.int32)), pa.array(K.signed(w.hash)))
            told = [languages.language(t) or "" for t in data["text"][a:b]]
            yield pa.RecordBatch.from_arrays([pa.array(data["class"][a:b], pa.int64()), pa.array(told), pa.array(np.diff(w.first), pa.int32()), lists], schema=schema)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many numbered words fall into each bucket of hashes."""
    counts = np.zeros(1 << BUCKETS, np.int64)
    for batch in batches:
        words, first = _flat(batch.column("words"))
        found = numbered(words, np.repeat(np.arange(len(first) - 1), np.diff(first)))
        counts += np.bincount((found >> np.uint64(64 - BUCKETS)).astype(np.int64), minlength=1 << BUCKETS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["bucket", "n"])


def _keys(ranked: str):
    """Adds the words in their common order, which the shards of all tasks need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(ranked)
        for batch in batches:
            words, first = _flat(batch.column("words"))
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(K.signed(ordered(words, first, ranks))))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "keys"])

    return run


def matches(train: DataFrame, val: DataFrame, alike: float = ALIKE, shard: int = SHARD) -> DataFrame:
    """train, record_id, coverage (part of the words of the longer one found in both) of all pairs alike in ``alike`` of their words."""
    spark = train.sparkSession
    told = documents(val, "record_id", "messages").select("record_id", F.md5(contents()).alias("key"), contents().alias("text"))
    members = table(told.groupBy("key", "record_id").agg(F.first("text").alias("text")), "eval")
    classes = members.groupBy("key").agg(F.min("record_id").alias("class"), F.first("text").alias("text"))
    schema = "class long, lang string, size int, words array<long>"
    hashed = table(classes.select("class", "text").mapInArrow(_hashes, schema), "words")
    ranked, path = new_path(spark, "ranks"), new_path(spark, "shards")
    hashed.select("words").mapInArrow(_buckets, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).write.parquet(ranked)
    shards = max(1, -(-hashed.count() // shard))
    # records of one language and like length make up a shard, so that a text meets few shards
    schema = f"{schema}, shard int, keys array<long>"
    hashed.repartitionByRange(shards, "lang", "size", "class").withColumn("shard", F.spark_partition_id()).mapInArrow(_keys(ranked), schema).write.partitionBy("shard").parquet(path)
    there = spark.read.schema(schema).parquet(path).where("size > 0").groupBy("shard").agg(F.min("size").alias("least"), F.max("size").alias("most")).orderBy("shard").collect()
    rows = documents(train, "record_id", "messages").select("record_id", contents().alias("text"))
    most = max(2 * spark.sparkContext.defaultParallelism, -(-rows.select("record_id").count() // TASK))  # each task reads every shard, so tasks are few and long
    found = rows.coalesce(most).mapInArrow(_scanner([(f"{path}/shard={r.shard}", r.least, r.most) for r in there], ranked, alike), "train long, class long, coverage double")
    ids = members.groupBy("key").agg(F.min("record_id").alias("class")).join(members.select("key", "record_id"), "key").select("class", "record_id")
    return found.join(ids, "class").where("train <> record_id").groupBy("train", "record_id").agg(F.max("coverage").alias("coverage"))


def overlaps(train: DataFrame, val: DataFrame, alike: float = ALIKE, shard: int = SHARD) -> DataFrame:
    """record_a, record_b (the smaller id first) of all pairs of a training and an evaluation record alike in ``alike`` of their words."""
    pairs = matches(train, val, alike, shard)
    return pairs.select(F.least("train", "record_id").alias("record_a"), F.greatest("train", "record_id").alias("record_b")).distinct()


def _splits(val: DataFrame) -> DataFrame:
    return documents(val, "record_id", "split").select("record_id", F.coalesce("split", F.lit("(none)")).alias("split")).dropDuplicates(["record_id"])


def coverage(found: DataFrame, val: DataFrame) -> DataFrame:
    """record_id, split, copies, exact, coverage of every evaluation record: training records alike, those of all its words, and the best coverage."""
    best = found.groupBy("record_id").agg(F.count(F.lit(1)).alias("copies"), F.count_if(F.col("coverage") == 1).alias("exact"), F.max("coverage").alias("coverage"))
    none = lambda c, x: F.coalesce(c, F.lit(x)).alias(c)
    return _splits(val).join(best, "record_id", "left").select("record_id", "split", none("copies", 0), none("exact", 0), F.round(F.coalesce("coverage", F.lit(0.0)), 6).alias("coverage"))


def report(found: DataFrame, train: DataFrame, val: DataFrame) -> DataFrame:
    """split, source (of the training record; null as '(none)'), pairs, eval_records, train_records, exact_pairs, mean_coverage."""
    t = documents(train, "record_id", "source").select(F.col("record_id").alias("train"), F.coalesce("source", F.lit("(none)")).alias("source")).dropDuplicates(["train"])
    rows = found.join(_splits(val), "record_id").join(t, "train").groupBy("split", "source")
    return rows.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("record_id").alias("eval_records"), F.countDistinct("train").alias("train_records"), F.count_if(F.col("coverage") == 1).alias("exact_pairs"), F.round(F.avg("coverage"), 6).alias("mean_coverage"))
