"""Packing by lexical retrieval: sequences of at most a window of tokens, each filled with documents about the same words.

A document's whole windows are sequences of their own. What is left of each goes to a shard of documents with words in
common (dealt by range over a signature, so no shard grows with the input, whatever its rows are). A shard holds a BM25
inverted index of its documents, with the frequencies of terms over all documents. The first document not used yet is a seed:
the index gives its best unused neighbours, which fill the seed's window in order; the last is cut where the window ends and
its rest stays in the index. So all sequences are full but a shard's last one, which is cut into lengths of powers of two, as
those need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import WorkTable, documents_of, mix, partitions, short_batches, slices, tidy
from .tokens import encoder, largest_id

WINDOW = 4096
#: Documents of a shard, terms of a seed that are looked up, neighbours taken from the index at a time.
SHARD, TERMS, NEIGHBOURS = 2048, 24, 48
K1, B = 1.2, 0.75

_PIECE = "doc long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in _PIECE.split(", ")]


def _terms(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and how often each is there."""
    s = np.sort(ids, kind="stable")  # by digits, for ids of two bytes
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[at], np.diff(np.append(at, len(s)))


def _signature(terms: np.ndarray) -> int:
    """Two terms of a document, drawn by hashes so that documents with the same terms draw the same, rarer ones likelier:
    ids of merged vocabularies rise as merges get rarer."""
    out = 0
    for seed in (1, 2):
        u = (mix(terms.astype(np.uint64) * np.uint64(2) + np.uint64(seed)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        out = out << 24 | int(terms[np.argmin(-np.log(u + 1e-300) / np.log2(terms + 2.0))])
    return out


def _encoded(path: str, kind: str, end_id: int, window: int, vocabulary: int):
    """Pieces that fill a window, rests of documents with their ids (data) and signature, and one row a task with the
    documents that each term is in (kind 2; doc_tokens: of all its documents, length: how many they are)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, pack = encoder(path, kind), zstandard.ZstdCompressor(level=1)
        task, count = TaskContext.get().partitionId() << 36, 0
        seen, docs, tokens = np.zeros(vocabulary, np.int64), 0, 0

        def rows(out: list) -> pa.RecordBatch:
            types = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.binary()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[*_NAMES, "kind", "signature", "data"])

        for part in (p for b in batches for p in slices(b, 1 << 21)):
            out = []
            for doc, ids in zip(part.column(0).to_pylist(), e.encode(part.column(1)), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                n = len(ids)
                for start in range(0, n - window + 1, window):
                    out.append((doc, start, window, zlib.crc32(ids[start : start + window].tobytes()), n, task | count, 0, 0, None, None))
                    count += 1
                terms, _ = _terms(ids.astype(np.uint16) if vocabulary <= 1 << 16 else ids)
                seen[terms] += 1
                docs, tokens = docs + 1, tokens + n
                if n % window:
                    out.append((doc, n - n % window, n % window, None, n, None, None, 1, _signature(terms), pack.compress(ids[n - n % window :].tobytes())))
            if out:
                yield rows(out)
        yield rows([(None, None, docs, None, tokens, None, None, 2, None, zlib.compress(seen.astype("<i8").tobytes(), 1))])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of rows (length, doc_tokens, data) of kind 2."""
    docs = tokens = 0
    seen = None
    for batch in batches:
        for n, t, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            docs, tokens = docs + n, tokens + t
            x = np.frombuffer(zlib.decompress(data), "<i8")
            seen = x if seen is None else seen + x
    if seen is not None:
        yield pa.record_batch([pa.array([docs], pa.int64()), pa.array([tokens], pa.int64()), pa.array([zlib.compress(seen.tobytes(), 1)])], names=["length", "doc_tokens", "data"])


class Index:
    """A BM25 inverted index of some documents' ids."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        both = [_terms(x) for x in ids]
        self.terms = [t for t, _ in both]
        term, often = np.concatenate(self.terms), np.concatenate([n for _, n in both])
        doc = np.repeat(np.arange(len(ids)), [len(t) for t in self.terms])
        length = np.array([len(x) for x in ids])
        weight = idf[term] * often * (K1 + 1) / (often + K1 * (1 - B + B * length[doc] / mean))
        # what a document's own terms tell of it, best first
        self.best = []
        at = 0
        for t in self.terms:
            w = weight[at : at + len(t)]
            self.best.append(t[np.argsort(-w, kind="stable")[:TERMS]] if len(t) > TERMS else t)
            at += len(t)
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.edge = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """How well each document matches the seed's terms."""
        out = np.zeros(len(self.terms))
        for t in self.best[seed].tolist():
            a, b = self.edge[t], self.edge[t + 1]
            out[self.doc[a:b]] += self.weight[a:b]  # a document is once in a term's list
        return out


def pack_shard(ids: list[np.ndarray], idf: np.ndarray, mean: float, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, first id, number of ids), which use each id once; all but those of the end are full."""
    index = Index(ids, idf, mean)
    used = np.zeros(len(ids), np.int64)  # ids of each document that have a place
    left = np.array([len(x) for x in ids])
    out, last = [], []
    for seed in range(len(ids)):
        if not left[seed]:
            continue
        sequence, room, best = [], window, [seed]
        scores = None
        while room and best:
            for d in best:
                n = int(min(room, left[d]))
                sequence.append((d, int(used[d]), n))
                used[d] += n
                left[d] -= n
                room -= n
                if not room:
                    break
            else:
                scores = index.scores(seed) if scores is None else scores
                free = np.flatnonzero(left)
                order = np.argsort(-scores[free], kind="stable")[:NEIGHBOURS]
                best = free[order].tolist()
        (last.extend if room else out.append)(sequence)
    # what did not fill a window (all of it from the shard's end): lengths of powers of two
    total, parts = sum(n for _, _, n in last), []
    while total:
        parts.append(1 << (total.bit_length() - 1) if total < window else window)
        total -= parts[-1]
    for size in parts:
        sequence = []
        while size:
            d, start, n = last.pop(0)
            take = min(n, size)
            sequence.append((d, start, take))
            if take < n:
                last.insert(0, (d, start + take, n - take))
            size -= take
        out.append(sequence)
    return out


def pack(docs: DataFrame, tokenizer: str, kind: str, end_id: int = 2, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of a document: `id_col`, start and length (ids of the document), ids_crc32, doc_tokens, sequence_id
    and offset (place in the sequence). Sequences have `window` ids, or a power of two.

    Null and empty texts are the end id alone, texts of any length are cut. Rows without an id get no row, rows that repeat
    an id count as one document; other columns play no part; an empty table gives an empty result. The pieces and sequences
    of equal inputs dealt alike are equal.
    """
    spark = docs.sparkSession
    short_batches(spark)
    vocabulary = max(largest_id(tokenizer), end_id) + 1
    schema = f"{_PIECE}, kind int, signature long, data binary"
    rows = WorkTable(documents_of(docs, id_col, text_col).mapInArrow(tidy(_encoded(tokenizer, kind, end_id, window, vocabulary)), schema), "pieces").read()
    sums = rows.where("kind = 2").select("length", "doc_tokens", "data")
    added = "length long, doc_tokens long, data binary"
    got = sums.mapInArrow(tidy(_added), added).repartition(8).mapInArrow(tidy(_added), added).collect()  # 8 rows at most
    seen = sum(np.frombuffer(zlib.decompress(r["data"]), "<i8") for r in got) if got else np.zeros(vocabulary)
    n, tokens = sum(r["length"] for r in got), sum(r["doc_tokens"] for r in got)
    idf = np.log(1 + (n - seen + 0.5) / (seen + 0.5)) if n else np.zeros(vocabulary)
    shared = spark.sparkContext.broadcast((idf, tokens / max(n, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean = shared.value
        unpack = zstandard.ZstdDecompressor()
        task, count, held = (1 << 61) | TaskContext.get().partitionId() << 36, 0, []

        def packed(held: list) -> pa.RecordBatch:
            nonlocal count
            ids = [np.frombuffer(unpack.decompress(x), "<u4") for *_, x in held]
            out = []
            for sequence in pack_shard([x.astype(np.uint16) if len(idf) <= 1 << 16 else x for x in ids], idf, mean, window):
                offset = 0
                for d, at, n in sequence:
                    out.append((held[d][0], held[d][1] + at, n, zlib.crc32(ids[d][at : at + n].tobytes()), held[d][2], task | count, offset))
                    offset += n
                count += 1
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=_NAMES)

        for batch in batches:
            held.extend(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            while len(held) >= SHARD:
                yield packed(held[:SHARD])
                held = held[SHARD:]
        if held:
            yield packed(held)

    rests = rows.where("kind = 1").select("doc", "start", "doc_tokens", "data", "signature")
    rests = rests.repartitionByRange(partitions(spark), "signature", "doc").sortWithinPartitions("signature", "doc").drop("signature")
    out = rows.where("kind = 0").select(*_NAMES).unionByName(rests.mapInArrow(tidy(run), _PIECE))
    return out.withColumnRenamed("doc", id_col)
