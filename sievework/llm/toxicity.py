"""Toxic passages by maximum-scoring segments.

Each word has a score: the log odds of toxic against clean documents with it, smoothed by Dirichlet priors along its
beginnings: the share of toxic documents among those with the first three letters is the prior for four letters, and so
on to the whole word; the share over all documents is the prior of the first. Less a constant, words of clean text score
below zero on average. One linear pass (Ruzzo and Tompa, 1999) then finds all maximal scoring segments of a document. How
high a segment scores by chance in a text so long follows an extreme-value distribution (Karlin and Altschul, 1990), fitted
to clean training documents: it turns scores into expected numbers of such segments, and tells the significant ones.
A document's best segment and all its significant ones, on that scale, give its probability by logistic regression.

Counts are of training documents, in a table of a fixed size by hash (each word beginning in two places; the less crowded
one counts). For calibration each training document is scored by the counts of all others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Spelling, WordValues, WorkTable, documents_of, mix, run_hash, short_batches, slices, tidy

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 20
#: Labelled rows to learn from, about; a parameter of `fit`.
SAMPLE = 40_000
CACHE = 300_000
PRIOR, DRIFT = 4.0, 0.7
BEGINNINGS = (3, 4, 5, 6, 8)
#: A segment is significant if fewer than so many are expected by chance.
SIGNIFICANT = 0.05


def places(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From the shortest beginning to the whole word: which words have such a beginning, and its two places for those."""
    s = Spelling(words)
    for n in BEGINNINGS:
        i = np.flatnonzero(s.end - s.start > n)
        h = run_hash(s.code, s.start[i], s.start[i] + n)
        yield i, (h % np.uint64(BUCKETS)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64)
    h = mix(run_hash(s.code, s.start, s.end))
    yield np.arange(len(words)), (h % np.uint64(BUCKETS)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Counts:
    #: Of documents, by place: toxic ones, and all.
    toxic: np.ndarray
    all: np.ndarray
    n_toxic: int
    n: int


def word_scores(words: list[str], c: Counts, less_toxic: int = 0, less: int = 0) -> np.ndarray:
    """The words' log odds, without a document (of which less_toxic says if it is toxic) if less is 1."""
    base = (c.n_toxic - less_toxic + 0.5) / (c.n - less + 1)
    rate = np.full(len(words), base)
    for i, a, b in places(words):
        at = np.where(c.all[a] <= c.all[b], a, b)
        rate[i] = (np.maximum(0, c.toxic[at] - less_toxic) + PRIOR * rate[i]) / (np.maximum(0, c.all[at] - less) + PRIOR)
    rate = np.clip(rate, 1e-6, 1 - 1e-6)  # a word of no other document than the one left out
    return np.log(rate / (1 - rate)) - math.log(base / (1 - base))


class Scorer:
    """Words' scores less the drift; remembers words."""

    def __init__(self, counts: Counts, less_toxic: int = 0, less: int = 0):
        self.values = WordValues(lambda words: word_scores(words, counts, less_toxic, less)[:, None] - DRIFT, 1, CACHE)

    def scores(self, texts: list[str | None]) -> list[np.ndarray]:
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        flat = [w for x in words for w in x]
        x = self.values.of(flat)[:, 0].astype(np.float64) if flat else np.zeros(0)
        return np.split(x, np.cumsum([len(w) for w in words])[:-1])


def segments(x: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, past the last, score) of x, in order."""
    up = np.flatnonzero(x > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(x)])
    # first, end, sum before, sum with it, and the place here of the last one with a smaller sum before it; following these
    # places passes over each segment once at most, until it is merged
    held: list[tuple[int, int, float, float, int]] = []
    for i, low, high in zip(up.tolist(), total[up].tolist(), total[up + 1].tolist(), strict=True):
        j = len(held) - 1
        while j >= 0 and held[j][2] >= low:
            j = held[j][4]
        k = (i, i + 1, low, high, j)
        while j >= 0 and held[j][3] < high:
            k = (held[j][0], i + 1, held[j][2], high, held[j][4])
            del held[j:]
            j = k[4]
        held.append(k)
    return [(a, b, r - l) for a, b, l, r, _ in held]


@dataclass
class Model:
    counts: Counts
    #: Of the extreme-value distribution.
    decay: float
    scale: float
    #: Of the logistic regression: constant, best segment, sum over significant ones.
    weights: tuple[float, float, float]

    def surprise(self, score: float, n: int) -> float:
        """Minus the log of how many segments with such a score are expected by chance in n words."""
        return self.decay * score - math.log(self.scale * max(n, 1))

    def passages(self, x: np.ndarray) -> list[tuple[int, int, float]]:
        """The significant segments with their surprise."""
        least = -math.log(SIGNIFICANT)
        return [(a, b, s) for a, b, score in segments(x) if (s := self.surprise(score, len(x))) >= least]

    def probability(self, best: float, significant: float) -> float:
        z = self.weights[0] + self.weights[1] * best + self.weights[2] * significant
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _features(surprises: list[float]) -> tuple[float, float]:
    """Of segments' surprises: the best, and how much all significant ones add up to; both damped."""
    least = -math.log(SIGNIFICANT)
    return math.log1p(max([0.0, *surprises])), math.log1p(sum(s for s in surprises if s >= least))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Weights by Newton's method with a small penalty."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(3), x.T @ (y - p) - 1e-3 * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from about so many of the labelled documents (by a hash of their ids), whole texts."""
    spark = docs.sparkSession
    marks = labels.select(F.col(id_col).cast("long").alias("doc"), F.col(label_col).cast("int").alias("y")).where("doc IS NOT NULL AND y IN (0, 1)").groupBy("doc").agg(F.max("y").alias("y"))
    n = marks.count()
    if n > sample:
        marks = marks.where(F.pmod(F.xxhash64("doc"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    # no more rows than `sample`, about, of 12 bytes
    rows = documents_of(docs, id_col, text_col).join(F.broadcast(marks), "doc").select("y", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS + 1), np.int64)
        for part in (p for b in batches for p in slices(b)):
            of_words = [list(set(WORD.findall((t or "").lower()))) for t in part.column(1).to_pylist()]
            flat = [w for x in of_words for w in x]
            doc = np.repeat(np.arange(len(of_words)), [len(x) for x in of_words])
            y = np.asarray(part.column(0))
            np.add.at(total[:, BUCKETS], y, 1)
            if flat:
                found = np.concatenate([doc[i] * BUCKETS + p for i, a, b in places(flat) for p in (a, b)])
                found = np.unique(found)  # a document counts once in a place
                np.add.at(total, (y[found // BUCKETS], found % BUCKETS), 1)
        at = np.flatnonzero(total.sum(axis=0))
        yield pa.record_batch([pa.array(at), pa.array(total[1, at]), pa.array(total.sum(axis=0)[at])], names=["place", "toxic", "n"])

    got = rows.mapInArrow(tidy(count), "place long, toxic long, n long").groupBy("place").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).toArrow()
    at = got.column("place").to_numpy()
    table = np.zeros((2, BUCKETS + 1), np.int32)
    table[0, at], table[1, at] = got.column("toxic").to_numpy(), got.column("n").to_numpy()
    counts = Counts(table[0, :-1], table[1, :-1], int(table[0, -1]), int(table[1, -1]))
    shared = spark.sparkContext.broadcast(counts)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = [Scorer(shared.value, y, 1) for y in (0, 1)]
        for part in (p for b in batches for p in slices(b)):
            out = []
            ys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            both = [by[k].scores(texts) for k in (0, 1)]
            for i, y in enumerate(ys):
                x = both[y][i]
                kinds, many = np.unique(np.round(x, 1), return_counts=True) if not y else (np.zeros(0), np.zeros(0, np.int64))
                out.append((y, len(x), [s for _, _, s in segments(x)], kinds.tolist(), many.tolist()))
            types = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64())]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["y", "n", "found", "kinds", "many"])

    # written once, so that whatever executor is lost, both readings see the same rows; no more rows than the sample
    scored = WorkTable(rows.mapInArrow(tidy(score), "y int, n long, found array<double>, kinds array<double>, many array<long>"), "segments")
    spread = scored.read().select(F.explode(F.arrays_zip("kinds", "many")).alias("x")).groupBy("x.kinds").agg(F.sum("x.many").alias("n")).collect()
    best = scored.read().where("y = 0 AND n > 0 AND size(found) > 0").select("n", F.array_max("found").alias("best")).toArrow()
    if not spread:
        return Model(counts, 1.0, 1.0, (0.0, 0.0, 0.0))
    value = np.array([r["kinds"] for r in spread])
    share = np.array([r["n"] for r in spread], float)
    share /= share.sum()
    low, high = 1e-3, 20.0
    for _ in range(60):  # the decay at which the mean of exp(decay * score) is 1
        mid = (low + high) / 2
        low, high = (low, mid) if float((share * np.exp(mid * value)).sum()) > 1 else (mid, high)
    decay = low
    clean = list(zip(best.column("best").to_pylist(), best.column("n").to_pylist(), strict=True))
    scale = max(1e-6, len(clean) / max(1e-9, sum(m * math.exp(-decay * s) for s, m in clean))) if clean else 1.0
    model = Model(counts, decay, scale, (0.0, 0.0, 0.0))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [_features([model.surprise(s, n) for s in found]) for n, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array([a for a, _ in both], pa.float64()), pa.array([b for _, b in both], pa.float64())], names=["y", "best", "all"])

    got = scored.read().select("y", "n", "found").mapInArrow(tidy(features), "y int, best double, all double").toArrow()
    scored.drop()
    x, y = np.column_stack([got.column("best").to_numpy(), got.column("all").to_numpy()]), got.column("y").to_numpy()
    model.weights = _logistic(x, y.astype(float))
    return model


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document (`id_col`) with score (0 to 1), predicted (1 if the score is 0.5 or more) and passages: the significant
    segments as struct(begin, stop, surprise) in words (runs of letters).

    Null and empty texts, and texts without letters, have no passage and the score of such. Rows without an id get no row,
    rows that repeat an id count as one document, other columns play no part.
    """
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m.counts)
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32()), ("surprise", pa.float64())]))
        for part in (p for b in batches for p in slices(b)):
            score, passages = [], []
            for x in scorer.scores(part.column(1).to_pylist()):
                found = [(a, b, m.surprise(s, len(x))) for a, b, s in segments(x)]
                score.append(m.probability(*_features([s for _, _, s in found])))
                passages.append([{"begin": a, "stop": b, "surprise": s} for a, b, s in found if s >= -math.log(SIGNIFICANT)])
            yield pa.record_batch([part.column(0), pa.array(score), pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array(passages, kind)], names=["doc", "score", "predicted", "passages"])

    return documents_of(docs, id_col, text_col).mapInArrow(tidy(run), "doc long, score double, predicted int, passages array<struct<begin:int,stop:int,surprise:double>>").withColumnRenamed("doc", id_col)
