"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are all windows of 13 consecutive words of the benchmark's items (an item of fewer words is one pattern).
For the patterns of one length, a table over blocks of two words tells how far the search may jump: by how much the
block's last place in any pattern's front part is short of its end, or by all of it where no pattern has the block.
Where it may not jump, the block is some pattern's end; the patterns with that end are told apart by their first
word, and a direct comparison of all words confirms an occurrence.

Words are numbers (a vocabulary of the benchmark's words tells them by their letters), and tables are flat arrays: about 40
bytes a word of the benchmark, and its distinct words. They reach the executors by broadcast and are set up once a worker.
A benchmark of up to SHARD_BYTES of text is one shard, so the documents are read once; a larger one is searched shard by
shard, whatever its size, and what the shards find of a document is then united.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import documents_of, short_batches, slices, tidy

WINDOW = 13
#: Bytes of benchmark text in one broadcast shard, about.
SHARD_BYTES = 32 << 20
#: A-Z as a-z; all other characters stay.
LOWER = str.maketrans({c: chr(c + 32) for c in range(0x41, 0x5B)})
#: Words: digits, letters a-z and whatever is not ASCII (of lower-cased text).
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.translate(LOWER)) if text else []


@dataclass
class Table:
    """For patterns of `length` words: how far to jump at a block of words (keys, sorted, and jumps), and for blocks that are the end
    of patterns (ends, sorted) which patterns these are: places of their first words in the benchmark, by first word."""

    length: int
    keys: np.ndarray
    jumps: np.ndarray
    ends: np.ndarray
    edge: np.ndarray
    place: np.ndarray
    first: np.ndarray


class Patterns:
    """The items of a shard as numbers, with their shift tables and suffix buckets."""

    def __init__(self, window: int = WINDOW):
        self.window, self.vocabulary, self.name = window, {}, uuid.uuid4().hex
        self._number, self._size, self._item, self.bytes = array("i"), array("q"), array("q"), 0

    def add(self, item: int, text: str) -> None:
        v, w = self.vocabulary, words(text)
        self._number.extend([v.setdefault(x, len(v)) for x in w])
        self._size.append(len(w))
        self._item.append(item)
        self.bytes += len(text.encode())

    def close(self) -> "Patterns":
        self.number = np.array(self._number, np.int32)
        size = np.array(self._size, np.int64)
        self.item, self.start = np.array(self._item, np.int64), np.cumsum(size) - size
        del self._number, self._size, self._item
        self.tables = [self._table(m, np.flatnonzero(np.minimum(size, self.window) == m), size) for m in np.unique(np.minimum(size, self.window)).tolist() if m]
        # sent as one text, much smaller than a dictionary
        self.vocabulary = "\n".join(self.vocabulary)
        return self

    def open(self) -> "Patterns":
        if isinstance(self.vocabulary, str):
            self.vocabulary = {w: i for i, w in enumerate(self.vocabulary.split("\n"))}
        return self

    def _blocks(self, last: np.ndarray, m: int) -> np.ndarray:
        """The two words (the one word, of patterns of one) up to each place."""
        n = self.number
        return n[last].astype(np.int64) if m == 1 else n[last - 1].astype(np.int64) << 32 | n[last]

    def _table(self, m: int, items: np.ndarray, size: np.ndarray) -> Table:
        block = min(2, m)

        def places(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """So many places of each item from its first word on, and which each is."""
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            return np.repeat(self.start[items], count) + nth, nth

        at, nth = places(size[items] - block + 1)
        # a block's last place in a pattern is the pattern's end, but for those too near the item's first word
        key, jump = self._blocks(at + block - 1, m), np.maximum(0, m - block - nth).astype(np.uint8)
        order = np.argsort(key, kind="stable")
        key, jump = key[order], jump[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        keys, jumps = key[new], np.minimum.reduceat(jump, new)
        place, _ = places(size[items] - m + 1)
        end, first = self._blocks(place + m - 1, m), self.number[place]
        order = np.lexsort((first, end))
        end = end[order]
        new = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
        return Table(m, keys, jumps, end[new], np.append(new, len(end)), place[order].astype(np.int32), first[order])

    def search(self, texts: list[list[str]]) -> list[tuple[list[tuple[int, int]], set[int]]]:
        """Of each text's words: the spans that some window's occurrence covers, united and in order, and the items with one."""
        get = self.vocabulary.get
        number = np.fromiter((get(x, -1) for w in texts for x in w), np.int64)
        found: list[tuple[list, set]] = [([], set()) for _ in texts]
        for t in self.tables:
            m = t.length
            block = number.copy()
            if m > 1:
                block[1:] |= number[:-1] << 32
                block[1:][(number[1:] < 0) | (number[:-1] < 0)] = -1
            i = np.minimum(np.searchsorted(t.keys, block), len(t.keys) - 1)
            jumps = np.where(t.keys[i] == block, t.jumps[i], m - min(2, m) + 1).tolist()
            base = 0
            for w, (spans, items) in zip(texts, found, strict=True):
                i, stop = base + m - 1, base + len(w)
                while i < stop:
                    by = jumps[i]
                    if by:
                        i += by
                        continue
                    k = int(np.searchsorted(t.ends, block[i]))
                    if k < len(t.ends) and t.ends[k] == block[i]:
                        a, b = t.edge[k], t.edge[k + 1]
                        lo, hi = np.searchsorted(t.first[a:b], [number[i - m + 1], number[i - m + 1] + 1])
                        for p in t.place[a + lo : a + hi].tolist():
                            if np.array_equal(self.number[p : p + m], number[i - m + 1 : i + 1]):
                                spans.append((i - m + 1 - base, i + 1 - base))
                                items.add(int(self.item[np.searchsorted(self.start, p, "right") - 1]))
                    i += 1
                base = stop
        return [(_united(s), i) for s, i in found]


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(set(spans)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_FOUND = "doc long, n_words long, spans array<struct<begin:int,stop:int>>, items array<long>"


def _shards(benchmark: DataFrame, item_col: str, text_col: str, most: int, window: int) -> Iterator[Patterns]:
    """The items in shards of so much text or one item; the driver holds one shard, as numbers, and a row at a time."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    held = Patterns(window)
    for r in rows.toLocalIterator():
        held.add(*r)
        if held.bytes >= most:
            yield held.close()
            held = Patterns(window)
    if held.bytes:
        yield held.close()


#: The shard that this worker has set up last.
_OPEN: list[Patterns] = []


def _opened(shared) -> Patterns:
    patterns = shared.value
    if not _OPEN or _OPEN[0].name != patterns.name:
        _OPEN[:] = [patterns.open()]
    return _OPEN[0]


def find_windows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Each document (`id_col`) with n_words, the spans of its words inside benchmark windows, and the items found.

    Null and empty texts have no words. Items without id or text are left out; rows that repeat an item's id add to it.
    Rows without a document id get no result, rows that repeat one count as one document. Empty tables are fine.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = documents_of(docs, id_col, text_col)
    spans_type, items_type = pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32())])), pa.list_(pa.int64())
    parts = []
    for shard in chain(_shards(benchmark, item_col, item_text_col, shard_bytes, window), (Patterns(window).close() for _ in range(1) if not parts)):
        shared = spark.sparkContext.broadcast(shard)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            patterns = _opened(shared)
            for part in (p for b in batches for p in slices(b)):
                texts = [words(t.as_py()) for t in part.column(1)]
                found = patterns.search(texts)
                spans = pa.array([[{"begin": s, "stop": e} for s, e in x] for x, _ in found], spans_type)
                yield pa.record_batch([part.column(0), pa.array(map(len, texts), pa.int64()), spans, pa.array([sorted(i) for _, i in found], items_type)], names=["doc", "n_words", "spans", "items"])

        parts.append(rows.mapInArrow(tidy(search), _FOUND))
    found = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            found = found.unionByName(p)
        found = found.groupBy("doc").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        # of sorted spans, what reaches past all before it; spans that touch stay apart, which no count sees
        past = "aggregate(spans, cast(array() AS array<struct<begin:int,stop:int>>), (a, x) -> IF(size(a) = 0 OR x.begin >= element_at(a, -1).stop, array_append(a, x), IF(x.stop > element_at(a, -1).stop, array_append(a, struct(element_at(a, -1).stop AS begin, x.stop AS stop)), a)))"
        found = found.withColumn("spans", F.expr(past))
    return found.withColumnRenamed("doc", id_col)


def contamination(docs: DataFrame, benchmark: DataFrame, share: int = 20, **names) -> DataFrame:
    """`find_windows` with n_hit (words inside spans), n_items and contaminated: n_hit is a 1/share of the words, at least."""
    found = find_windows(docs, benchmark, **names)
    found = found.withColumn("n_hit", F.expr("aggregate(spans, 0L, (a, x) -> a + x.stop - x.begin)")).withColumn("n_items", F.size("items").cast("long"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns. Rows without an id have no result and go."""
    bad = contamination(docs, benchmark, id_col=id_col, **names).where("contaminated").select(F.col(id_col).alias("__bad"))
    return docs.where(F.col(id_col).isNotNull()).join(bad, F.col(id_col) == F.col("__bad"), "left_anti")


def items_sha256(items: list[int]) -> str:
    """What `items_sha256` of the query holds, for one document; a reference for tests."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
