"""What the operators of this package share: work tables, row identity, and word scanning of Arrow batches.

Work tables are Parquet under ``spark.checkpoint.dir`` (shared by driver and executors on a cluster), in a folder of
this application. A returned DataFrame may still read them, so they stay until :func:`release` is called.

Hashes by prefix sums (`run_hash`) only choose places and deal rows; texts that differ may be made to agree in them. Where
contents must be told apart, they are compared, or digests of 128 bits are (`digests`).
"""

from __future__ import annotations

import ctypes
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch holds at most; with long texts the session's byte bound on batches cuts it sooner.
BATCH_ROWS = 2000


def work_dir(spark: SparkSession) -> str:
    """The folder of this application's work tables. In local mode a folder beside the warehouse stands in where no checkpoint
    folder is set; on a cluster that might be a machine's own, so the setting is asked for."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-work"
    return f"{top.rstrip('/')}/sievework-{spark.sparkContext.applicationId}"


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Deletes all work tables of this application; call it when no result that reads them is needed any more."""
    _remove(spark, work_dir(spark))


class WorkTable:
    """A table written once, so that what follows never recomputes it, whichever executor is lost."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path, self.schema = df.sparkSession, f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}", df.schema
        df.write.option("compression", "zstd").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        _remove(self.spark, self.path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    return WorkTable(df, name).read()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for `mapInArrow`; a worker that waits for its next task hands freed memory back to the system."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return task


def short_batches(spark: SparkSession) -> None:
    """Texts are long: fewer rows in an Arrow batch bound a Python worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def documents_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc`` (long) and ``text`` of the rows that have an id, one row an id, whatever other columns there are.

    Rows without an id have no identity and get no result. Rows that repeat an id count as one, with the smallest text
    that is not null. Whether ids repeat is looked up first, over the id column alone, since the rare merge moves texts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc IS NOT NULL")
    repeated = rows.select("doc").groupBy("doc").count().where("count > 1").limit(1).count()
    return rows.groupBy("doc").agg(F.min("text").alias("text")) if repeated else rows


# -- word scanning -----------------------------------------------------------------------------------------------

#: The bytes that part words: the blank and U+0009 to U+000D.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number modulo 2^64 and those of its inverse, n of each at least."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            a = np.full(size, x, np.uint64)
            a[0] = 1
            _POWERS[i] = np.cumprod(a, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values, so that each bit depends on all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hash(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of values[first:last] for each pair, by prefix sums of a polynomial; the same wherever the run stands. Runs
    that differ can be made to agree (Thue-Morse words): it proposes, and never decides what is equal."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def digests(parts: list[bytes]) -> np.ndarray:
    """128 bits of each, as a row of two signed numbers."""
    return np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in parts]), "<i8").reshape(-1, 2)


class Words:
    """The words of some texts: flat arrays over all of them, nothing per word in Python."""

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null("")
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int32, count=len(texts) + 1, offset=texts.offset * 4).astype(np.int64)
        self.data = np.frombuffer(data, np.uint8, count=int(at[-1])) [int(at[0]) :] if data is not None and len(texts) else np.zeros(0, np.uint8)
        at = at - at[0] if len(at) else at
        word = ~_BLANK[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[at] = True  # a text's edge parts words as a blank does
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | edge[1:-1]
        ends[:-1] &= ~word[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        #: of[i]: the index of word i's text; first[d]: the index of text d's first word.
        self.first = np.searchsorted(self.start, at)
        self.of = np.repeat(np.arange(len(at) - 1), np.diff(self.first))

    @cached_property
    def hash(self) -> np.ndarray:
        """Of each word, as `run_hash`."""
        return run_hash(self.data.astype(np.uint64) + np.uint64(1), self.start, self.end)

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words, each with one blank behind it, and where each begins (and the end): words i to j are the bytes from
        the i-th place to one before the j-th."""
        size = self.end - self.start + 1
        at = np.concatenate([[0], np.cumsum(size)])
        out = np.full(int(at[-1]), 0x20, np.uint8)
        own = np.ones(len(out), bool)
        own[at[1:] - 1] = False
        out[own] = self.data[np.repeat(self.start - at[:-1], size)[own] + np.flatnonzero(own)]
        return out.tobytes(), at

    def numbers(self) -> np.ndarray:
        """A number for each word, equal for equal words only; of use among the words of this object."""
        size = self.end - self.start
        data = np.concatenate([self.data, np.zeros(16, np.uint8)])
        lane = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        # up to 16 bytes, the first and the last eight (or what there is) and the length are the word
        first = lane[self.start] & _KEEP[np.minimum(size, 8)]
        last = np.where(size > 8, lane[np.maximum(self.end - 8, 0)], np.uint64(0))
        long = np.flatnonzero(size > 16)
        if len(long):
            seen: dict[bytes, int] = {}
            raw = self.data.tobytes()
            first[long] = [seen.setdefault(raw[s:e], len(seen)) for s, e in zip(self.start[long].tolist(), self.end[long].tolist(), strict=True)]
            last[long] = 0
            size = np.where(size > 16, 17, size)
        order = np.lexsort((size, last, first))
        first, last, size = first[order], last[order], size[order]
        new = np.zeros(len(order), np.int64)
        new[1:] = (first[1:] != first[:-1]) | (last[1:] != last[:-1]) | (size[1:] != size[:-1])
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(new)
        return out

    def grams(self, k: int) -> np.ndarray:
        """A hash of the k words from each word on; what crosses a text's end has no meaning."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * np.uint64(_BASE) + self.hash[j : j + n]
        return mix(out)

    def anchors(self, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Minimisers: each window of `window` words has, of the hashes of its k-word runs, one smallest (the leftmost).

        Equal windows have equal ones at equal places. Returns the places of these runs, their hashes, and the first and
        last window (by its first word) that each stands for.
        """
        grams = self.grams(k)
        last = self.first[1:][self.of] if len(self.of) else self.of
        begin = np.flatnonzero(np.arange(len(self.of)) + window <= last)
        if not len(begin):
            none = np.zeros(0, np.int64)
            return none, np.zeros(0, np.uint64), none, none
        width = window - k + 1
        best, at = grams[begin], begin.copy()
        for j in range(1, width):
            other = grams[begin + j]
            less = other < best
            best = np.where(less, other, best)
            at[less] = begin[less] + j
        new = np.ones(len(at), bool)
        # a minimiser's windows are consecutive; they end with the text too, as windows of one text only are looked at
        new[1:] = (at[1:] != at[:-1]) | (begin[1:] != begin[:-1] + 1)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(at)) - 1
        return at[heads], best[heads], begin[heads], begin[tails]


def slices(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of (id, text) with about so many bytes of text, one row at least."""
    texts = batch.column(1)
    if not len(texts):
        return
    size = np.frombuffer(texts.buffers()[1], np.int32, count=len(texts) + 1, offset=texts.offset * 4).astype(np.int64)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(size, size[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


# -- values of distinct words ------------------------------------------------------------------------------------


class Spelling:
    """The characters of some words, none of them empty, as one flat array: code, and each word's first and past its last."""

    def __init__(self, words: list[str], before: str = "", after: str = ""):
        text = before + (after + before).join(words) + after
        self.code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, words), np.int64, len(words)) + len(before) + len(after)
        self.end = np.cumsum(size)
        self.start = self.end - size


class WordValues:
    """Remembers a row of numbers for each distinct word, up to so many words; new ones are computed together."""

    def __init__(self, compute, width: int, limit: int):
        self.compute, self.rows, self.known = compute, np.zeros((limit, width), np.float32), {}

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = list(set(words) - known.keys())
        if len(known) + len(new) > len(self.rows):
            known.clear()
            new = list(set(words))
            if len(new) > len(self.rows):
                self.rows = np.zeros((len(new), self.rows.shape[1]), np.float32)
        if new:
            first = len(known)
            self.rows[first : first + len(new)] = self.compute(new)
            known.update(zip(new, range(first, first + len(new)), strict=True))
        return self.rows[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]
