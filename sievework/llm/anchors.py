"""Which passages may repeat across documents: minimisers, counted over the whole corpus, then a filter of fixed size.

A window of words is represented by the smallest hash of its short word runs, so equal windows share one. Hashes found in
two documents or more (an aggregate with map-side sums, so a passage that a third of all rows share is one row a task)
go into a bit table of a fixed size, which is all that is broadcast. The table only saves work: where it is crowded,
more passages are looked at than need be, and none that repeats is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Words, slices, tidy

#: 64-bit words of the bit table: 16 MB.
TABLE_WORDS = 1 << 21


def repeated(rows: DataFrame, window: int, k: int) -> DataFrame:
    """h, the hash of a minimiser that two documents or more have, and n, in how many rows of `slices` it is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column(1))
                at, h, _, _ = w.anchors(window, k)
                of = w.of[at]
                order = np.lexsort((of, h))
                h, of = h[order], of[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
                h, ids = h[new], np.asarray(part.column(0))[of[new]]
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(ids)], names=["h", "doc"])

    found = rows.mapInArrow(tidy(run), "h long, doc long").groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count("*").alias("n"))
    return found.where("a < b").select("h", "n")


def bit_table(hashes: DataFrame, words: int = TABLE_WORDS) -> Broadcast:
    """A table of 64 * words bits (a power of two), with one set for each hash (column h); summed up before it is sent."""
    shift = 64 - (words.bit_length() - 1)
    at = F.shiftrightunsigned("h", shift)
    parts = hashes.select(at.alias("w"), F.expr("shiftleft(1L, cast(h & 63 AS int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    table = np.zeros(words, np.uint64)
    got = parts.toArrow()  # no more rows than the table has words
    table[got.column("w").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(table)


def in_table(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    shift = np.uint64(64 - (len(table).bit_length() - 1))
    return (table[(h >> shift).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1
