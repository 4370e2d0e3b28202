"""Substring deduplication by suffix automata of reference shards.

What is removed is judged over windows of words (13 by default): a word goes if a window that covers it also starts in a
document with a smaller id. Shards hold reference passages, each with the smallest id it is found in, in a suffix
automaton over words; its states carry the smallest id of all places they stand for. Passages stream through it word by
word: where the matching statistic (the longest suffix of what was read that is in the references) reaches a window, the
state of that window's length tells the smallest id.

One automaton of all documents, sent to all, would have each document read as often as there are shards, which grows
with the square of the corpus. Shards are therefore cut by the minimiser of a window: equal windows share it, so a
passage only needs the automaton of its own minimiser. Only passages whose minimiser two documents have take part
(`anchors`). Passages are named by 128 bits of a digest of their words; equal ones in a batch of documents are one
reference row. The automaton of a minimiser is small and is used only where its passages are, so it is built there
instead of being broadcast.

A minimiser within words that very many documents have (a line, a license) stands for as many passages, each with other
words around it. They would all meet in one task. Where a minimiser has more than PASSAGES rows, its windows are named one by one,
by digests too, and summed up by an aggregate, which spreads over all tasks: the same ids, another way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import bit_table, in_table, repeated
from .base import WorkTable, Words, digests, documents_of, partitions, short_batches, slices, tidy

WINDOW, GRAM = 13, 5
#: Rows of one minimiser that go to an automaton; of one with more, each window is a row of its own.
PASSAGES = 2000


class SuffixAutomaton:
    """Of several word sequences; `least` has for each state the smallest id of the sequences with it."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.least = [-1], [0], [1 << 62]

    def _state(self, length: int, link: int, go: dict, least: int) -> int:
        self.next.append(go)
        self.length.append(length)
        self.link.append(link)
        self.least.append(least)
        return len(self.link) - 1

    def _copy(self, p: int, word, q: int) -> int:
        """A state for the shorter part of q that ends in state p's words and this one."""
        c = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), self.least[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def add(self, words: list, least: int) -> None:
        last = 0
        for w in words:
            q = self.next[last].get(w)
            if q is not None:  # another sequence has this already
                last = q if self.length[q] == self.length[last] + 1 else self._copy(last, w, q)
            else:
                new, p = self._state(self.length[last] + 1, 0, {}, 1 << 62), last
                while p >= 0 and w not in self.next[p]:
                    self.next[p][w] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][w]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, w, q)
                last = new
            if least < self.least[last]:
                self.least[last] = least

    def close(self) -> None:
        """Hands ids on from longer states to the shorter ones that end like them."""
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            p = self.link[v]
            if self.least[v] < self.least[p]:
                self.least[p] = self.least[v]

    def windows(self, words: list, n: int) -> list[int]:
        """For each run of n words: the smallest id of a sequence with it, 2^62 if none has it."""
        v = size = 0
        out = []
        for i, w in enumerate(words):
            while v and w not in self.next[v]:
                v = self.link[v]
                size = self.length[v]
            if w in self.next[v]:
                v, size = self.next[v][w], size + 1
            while self.link[v] >= 0 and self.length[self.link[v]] >= n:
                v = self.link[v]
                size = min(size, self.length[v])
            if i >= n - 1:
                out.append(self.least[v] if size >= n else 1 << 62)
        return out


_PASSAGE = "x long, y long, doc long, first long, h long, text string"


def _passages(rows: DataFrame, table, crowded, window: int, k: int) -> WorkTable:
    """Of minimisers in the table: passages by their digest (x, y), the document and the place of the first word; h and text
    are null where the batch has the passage already. Of crowded minimisers, each window, with h null and the text empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column(1))
                _, h, lo, hi = w.anchors(window, k)
                use = in_table(table.value, h)
                h, lo, hi = h[use], lo[use], hi[use]
                if not len(h):
                    continue
                singly = in_table(crowded.value, h)
                times = np.where(singly, hi - lo + 1, 1)
                of = np.repeat(np.arange(len(h)), times)
                begin = lo[of] + np.arange(len(of)) - (np.cumsum(times) - times)[of]
                singly, h = singly[of], h[of]
                stop = np.where(singly, begin, hi[of]) + window
                data, at = w.joined()
                words = [data[i:j] for i, j in zip(at[begin].tolist(), (at[stop] - 1).tolist(), strict=True)]
                name = digests(words)
                doc = np.asarray(part.column(0))[w.of[begin]]
                order = np.lexsort((doc, name[:, 1], name[:, 0]))
                new = np.ones(len(h), bool)
                new[1:] = (name[order][1:] != name[order][:-1]).any(axis=1)
                told = np.zeros(len(h), bool)
                told[order[new]] = True
                text = [("" if s else x.decode()) if t else None for x, t, s in zip(words, told.tolist(), singly.tolist(), strict=True)]
                yield pa.record_batch(
                    [pa.array(name[:, 0]), pa.array(name[:, 1]), pa.array(doc), pa.array(begin - w.first[w.of[begin]]), pa.array(h.view(np.int64), mask=~told | singly), pa.array(text, pa.string())],
                    names=["x", "y", "doc", "first", "h", "text"],
                )

    return WorkTable(rows.mapInArrow(tidy(run), _PASSAGE), "passages")


def _least(window: int):
    """Of rows (h, x, y, text, least) sorted by h: for each passage the smallest id of each of its windows."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []

        def finish(found: dict) -> None:
            """found: by digest, words and smallest id."""
            if len(found) == 1:
                ((name, (text, least)),) = found.items()
                out.append((*name, [least] * (text.count(" ") + 2 - window)))
            else:
                a = SuffixAutomaton()
                parted = {name: (text.split(" "), least) for name, (text, least) in found.items()}
                for words, least in parted.values():
                    a.add(words, least)
                a.close()
                out.extend((*name, a.windows(words, window)) for name, (words, _) in parted.items())

        def batch_of() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            return b

        h, found = None, {}
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("h", "x", "y", "text", "least")), strict=True)
            for key, group in groupby(rows, key=lambda r: r[0]):
                if key != h:
                    if found:
                        finish(found)
                    h, found = key, {}
                for _, x, y, text, least in group:
                    had = found.get((x, y))
                    if had is None or least < had[1]:
                        found[x, y] = (text, least)
                if len(out) >= 5000:
                    yield batch_of()
        if found:
            finish(found)
        if out:
            yield batch_of()

    return run


def covered_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = PASSAGES) -> DataFrame:
    """doc and starts: the places (sorted) of the windows that also start in a document with a smaller id."""
    spark = docs.sparkSession
    anchors = WorkTable(repeated(docs, window, gram), "anchors").read()
    passages = _passages(docs, bit_table(anchors), bit_table(anchors.where(F.col("n") > most)), window, gram).read()
    # the row of a batch that has a passage's text has the smallest id of the batch too
    refs = passages.where("h IS NOT NULL").select("h", "x", "y", F.col("doc").alias("least"), "text").repartition(partitions(spark), "h").sortWithinPartitions("h")
    by_passage = refs.mapInArrow(tidy(_least(window)), "x long, y long, ids array<long>")
    by_window = passages.where("text = ''").groupBy("x", "y").agg(F.min("doc").alias("least")).select("x", "y", F.array("least").alias("ids"))
    ids = WorkTable(by_passage.unionByName(by_window), "least").read()
    hit = passages.select("x", "y", "doc", "first").join(ids, ["x", "y"]).where(F.array_min("ids") < F.col("doc"))
    starts = F.expr("filter(transform(ids, (x, i) -> IF(x < doc, first + i, NULL)), x -> x IS NOT NULL)")
    return hit.select("doc", starts.alias("starts")).groupBy("doc").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def cover(starts: list[int] | None, n: int, window: int) -> np.ndarray:
    """Which of n words the windows at these places cover."""
    edge = np.zeros(n + 1, np.int64)
    if starts is not None and len(starts):
        s = np.unique(np.asarray(starts, np.int64))
        edge[s] += 1
        np.subtract.at(edge, s + window, 1)
    return np.cumsum(edge[:-1]) > 0


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Each document (`id_col`) with n_words, n_removed, kept (the words that stay, joined by one blank) and kept_sha256.

    Null and empty texts have no words; texts with fewer words than a window keep all. Windows are judged on the input.
    An empty table gives an empty result.
    Rows without an id get no row, rows that repeat an id count as one document, other columns play no part.
    """
    short_batches(docs.sparkSession)
    rows = documents_of(docs, id_col, text_col)
    both = rows.join(covered_windows(rows, window, gram), "doc", "left").select("doc", "text", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, kept, sha = [], [], [], []
            for text, starts in zip(batch.column(1), batch.column(2), strict=True):
                w = (text.as_py() or "").encode().split()
                if starts.is_valid:
                    gone = cover(starts.values.to_numpy(), len(w), window)
                    stay = [x for x, g in zip(w, gone.tolist(), strict=True) if not g]
                else:
                    stay = w
                joined = b" ".join(stay)
                n.append(len(w))
                removed.append(len(w) - len(stay))
                kept.append(joined)
                sha.append(hashlib.sha256(joined).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sha)], names=["doc", "n_words", "n_removed", "kept", "kept_sha256"])

    return both.mapInArrow(tidy(run), "doc long, n_words long, n_removed long, kept string, kept_sha256 string").withColumnRenamed("doc", id_col)
