"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1; for each of its places a binary classifier over the character n-grams of words
(naive Bayes over hashed n-grams) tells which languages' side a text is on. Decoding takes the language whose codeword has
the smallest loss, the sum of logistic losses weighted by how well each classifier does for that language on the training
rows; where the two best are close, the text is flagged as ambiguous.

The model is fitted on a bounded sample of the rows that may be learned from (`sample` of them, by a hash of the id); what is
sent to the executors has a size that depends on the languages and the n-gram buckets only.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Spelling, WordValues, documents_of, run_hash, short_batches, slices, tidy

WORD = re.compile(r"[^\W\d_]+")
BUCKETS, NGRAMS = 1 << 14, (1, 2, 3, 4)
#: Training rows, about; a parameter of `fit`.
SAMPLE = 20_000
#: Words whose n-grams a worker remembers.
CACHE = 200_000
UNKNOWN = "und"


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each character of the words (with a sign before and behind each) and each n, the bucket of the n characters from
    it on, BUCKETS where the word ends sooner; and where each word begins."""
    s = Spelling(words, "^", "$")
    out = np.full((len(NGRAMS), len(s.code)), BUCKETS, np.int64)
    left = np.repeat(s.end, s.end - s.start) - np.arange(len(s.code))
    for i, n in enumerate(NGRAMS):
        at = np.flatnonzero(left >= n)
        out[i, at] = run_hash(s.code, at, at + n) % np.uint64(BUCKETS)
    return out, s.start


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of n languages: all ways to part them if they are few, else the random code, of a
    hundred, whose closest rows are farthest apart."""
    if n <= 1:
        return np.ones((n, 0), np.int8)
    if n <= 5:
        return np.array([(1, *c) for c in product((1, -1), repeat=n - 1) if -1 in c], np.int8).T
    bits, rng, best = 15 * (n - 1).bit_length(), np.random.default_rng(7), (-1, None)
    for _ in range(100):
        c = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        apart = min(int((c[i] != c[j]).sum()) for i in range(n) for j in range(i))
        if apart > best[0] and (abs(c.astype(int).sum(axis=0)) < n).all():
            best = (apart, c)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    #: For each bucket and place of the codewords the log odds of its sides.
    odds: np.ndarray
    #: For each language and place, how well the classifier does there; rows sum to 1.
    weight: np.ndarray


class Reader:
    """Mean log odds of texts' n-grams; remembers words."""

    def __init__(self, odds: np.ndarray):
        # the last column counts n-grams, the last row is that of no n-gram
        self.odds = np.ones((BUCKETS + 1, odds.shape[1] + 1), np.float32)
        self.odds[:-1, :-1] = odds
        self.odds[-1] = 0
        self.values = WordValues(self._sums, self.odds.shape[1], CACHE)

    def _sums(self, words: list[str]) -> np.ndarray:
        bucket, start = ngrams(words)
        total = self.odds[bucket[0]]
        for b in bucket[1:]:
            total += self.odds[b]
        return np.add.reduceat(total, start, axis=0)

    def margins(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """A row for each text, and how many words it has."""
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        size = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros((len(texts), self.odds.shape[1]))
        some = np.flatnonzero(size)
        if len(some):
            rows = self.values.of([w for x in words for w in x])
            out[some] = np.add.reduceat(rows, (np.cumsum(size) - size)[some], axis=0, dtype=np.float64)
        return out[:, :-1] / np.maximum(out[:, -1:], 1), size


def losses(model: Model, margins: np.ndarray) -> np.ndarray:
    """For each language, the weighted logistic loss of its codeword."""
    return (np.logaddexp(0, -4.0 * model.codes * margins) * model.weight).sum(axis=1)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of the languages (not null) in docs, from so many rows about, with whole texts. Without any, it has none."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("doc IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    count = rows.groupBy("lang").count()
    counts = {r["lang"]: r["count"] for r in count.collect()}
    languages = sorted(counts)
    codes = codewords(len(languages))
    if not codes.size:
        return Model(languages, codes, np.zeros((BUCKETS, 0), np.float32), np.ones(codes.shape))
    # each language has an equal part of the sample, or all rows it has
    share = max(1, sample // len(languages))
    keep = F.lit(False)
    for lang, n in counts.items():
        keep = keep | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("doc"), F.lit(1 << 30)) < int(min(1.0, share / n) * (1 << 30))))
    rows = rows.where(keep).select("lang", "text")
    of = {x: i for i, x in enumerate(languages)}

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS + 1))
        for batch in batches:
            for part in slices(batch):
                words: dict[int, Counter] = defaultdict(Counter)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    words[of[lang]].update(WORD.findall(text.as_py().lower()))
                for lang, seen in words.items():
                    if seen:
                        bucket, start = ngrams(list(seen))
                        often = np.repeat(list(seen.values()), np.diff(np.append(start, bucket.shape[1])))
                        for b in bucket:
                            total[lang] += np.bincount(b, often, BUCKETS + 1)
        lang, bucket = np.nonzero(total[:, :-1])
        yield pa.record_batch([pa.array(lang), pa.array(bucket), pa.array(total[lang, bucket].astype(np.int64))], names=["lang", "bucket", "n"])

    counted = rows.mapInArrow(tidy(count_grams), "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((len(languages), BUCKETS))
    n[counted.column("lang").to_numpy(), counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    rate = (n + 0.1) / (n + 0.1).sum(axis=1, keepdims=True)
    plus, minus = (codes.T > 0).astype(float), (codes.T < 0).astype(float)
    odds = np.log(plus @ rate / plus.sum(axis=1, keepdims=True)) - np.log(minus @ rate / minus.sum(axis=1, keepdims=True))
    odds = odds.T.astype(np.float32)
    shared = spark.sparkContext.broadcast(odds)

    def count_right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, reader = np.zeros((len(languages), codes.shape[1] + 1), np.int64), Reader(shared.value)
        for batch in batches:
            for part in slices(batch):
                margins, words = reader.margins(part.column(1).to_pylist())
                for lang, m, n in zip(part.column(0).to_pylist(), margins, words, strict=True):
                    if n:
                        right[of[lang], :-1] += m * codes[of[lang]] > 0
                        right[of[lang], -1] += 1
        yield pa.record_batch([pa.array(np.arange(len(languages))), pa.array(list(right), pa.list_(pa.int64()))], names=["lang", "right"])

    right = np.ones((len(languages), codes.shape[1] + 1))
    got = rows.mapInArrow(tidy(count_right), "lang long, right array<long>").select("lang", F.posexplode("right").alias("place", "n")).groupBy("lang", "place").agg(F.sum("n").alias("n")).collect()
    for r in got:
        right[r["lang"], r["place"]] += r["n"]
    weight = right[:, :-1] / right[:, -1:]
    return Model(languages, codes, odds, weight / weight.sum(axis=1, keepdims=True))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", margin: float = 0.05) -> DataFrame:
    """Each document (`id_col`) with lang_pred, score (0 to 1) and ambiguous (the two best differ by less than margin).

    Texts that are null or have no letter, and all texts where the model knows no language, are `und` with score 0, and
    ambiguous. Rows without an id get no row, rows that repeat one count as one document; other columns play no part.
    """
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        reader = Reader(m.odds)
        for part in (p for b in batches for p in slices(b)):
            lang, score, unsure = [], [], []
            texts = part.column(1).to_pylist()
            margins, words = reader.margins(texts)
            for text, x, n in zip(texts, margins, words.tolist(), strict=True):
                # the word pattern also takes characters such as raised digits, and may miss none of the letters
                if not m.languages or not text or not ((n and WORD.search(text)[0].isalpha()) or any(map(str.isalpha, text))):
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    unsure.append(True)
                    continue
                p = np.exp(-4.0 * losses(m, x))
                p /= p.sum()
                best = int(p.argmax())
                lang.append(m.languages[best])
                score.append(float(p[best]))
                unsure.append(len(p) > 1 and float(p[best] - np.partition(p, -2)[-2]) < margin)
            yield pa.record_batch([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], names=["doc", "lang_pred", "score", "ambiguous"])

    return documents_of(docs, id_col, text_col).mapInArrow(tidy(run), "doc long, lang_pred string, score double, ambiguous boolean").withColumnRenamed("doc", id_col)


def crc_mod(id_col: str, n: int) -> F.Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n
