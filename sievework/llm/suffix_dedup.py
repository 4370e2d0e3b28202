"""Repeated passages by a sparse suffix array.

Suffixes are kept at content-selected places only: the minimisers of windows of 50 words. Any 50 words that repeat have the
same minimiser at the same place, so both places' suffixes are kept. Rows are sorted by (minimiser, words from it on); next to
each other stand those with the longest common beginnings. Where the common beginning of neighbours (LCP, in words) falls
below d, rows part into intervals whose first d words are equal. A match is then extended to the left: a window that begins o
words before its minimiser is equal to another one if both are in one interval at d = 50 - o and the o words before are
equal, word by word. All rows of an interval are compared with one another by sorting, so none is lost, however many share
its beginning. Words are told by their bytes.

Only minimisers found twice take part. Where places with one passage follow one another in a text (words that repeat at a period,
such as one word many times), they are one row that tells how far on the last of them is. Where all places of a minimiser have the same passage (copies), suffixes tell nothing
more: the passage is one row, named by 128 bits of a digest of its words. A minimiser's suffixes go to one
task if they are LONG at most, else they are dealt by range over (words, document, place): so does a line that a third of all
rows have, with other words around it. Of such a minimiser an interval at a task's first or last row may go on in the next task;
only windows of such intervals are named by digests too. Rows of one name
are found by sorting (name, document, place); names at the borders between tasks, and very long runs of one, are summed up by
an aggregate: two keys a task and one for each LONG rows at most, which are broadcast to the rows of those runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import bit_table, in_table
from .base import WorkTable, Words, digests, documents_of, partitions, short_batches, slices, tidy

WORDS, GRAM = 50, 8
#: Rows of one minimiser (some 70 MB), or of one passage, that a task compares at once; a minimiser with more is dealt over several tasks.
LONG = 100_000
#: Rows of suffixes that a task gathers before it compares them (whole minimisers).
TOGETHER = 8_000

#: A place: either a named passage of n windows from word pos on (x, y: its digest), or a suffix from word pos on (after: its
#: words, before: those before it that a window may have, n: of them, the windows begin most to least words before it). The same
#: again is at each n words further on, up to `on`.
_PLACE = "h long, x long, y long, doc long, pos long, n long, on long, after string, before string, least long, most long, crowded long"
#: Named ones: n windows from begin on, and the same again at each `step` words further on, up to `on`.
_FOUND = "doc long, begin long, stop long, gone_begin long, gone_stop long, other long, h long, x long, y long, n long, step long, on long"


def _distinct(data: bytes, at: np.ndarray, of: np.ndarray, spot: np.ndarray, h: np.ndarray, lo: np.ndarray, hi: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of places in their order: the first of those that follow one another in a text with equal passages, windows and minimisers in
    them, and how many words on the last one is."""
    same = (h[1:] == h[:-1]) & (of[1:] == of[:-1]) & (lo[1:] == hi[:-1] + 1) & (spot[1:] - lo[1:] == spot[:-1] - lo[:-1]) & (hi[1:] - lo[1:] == hi[:-1] - lo[:-1])
    i = np.flatnonzero(same)
    begin, stop = at[lo], at[hi + words]
    equal = [data[a:b] == data[c:d] for a, b, c, d in zip(begin[i].tolist(), stop[i].tolist(), begin[i + 1].tolist(), stop[i + 1].tolist(), strict=True)]
    head = np.ones(len(h), bool)
    head[i[np.array(equal, bool)] + 1] = False
    first = np.flatnonzero(head)
    return first, lo[np.append(first[1:], len(h)) - 1] - lo[first]


def _minimisers(rows: DataFrame, words: int, gram: int) -> DataFrame:
    """h of the minimisers at two places or more, in how many rows they are, and whether their passages differ (mixed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column(1))
                spot, h, lo, hi = w.anchors(words, gram)
                if not len(h):
                    continue
                data, at = w.joined()
                first, _ = _distinct(data, at, w.of[lo], spot, h, lo, hi, words)
                n, h, lo, hi = np.diff(np.append(first, len(h))), h[first], lo[first], hi[first]
                name = digests([data[i:j] for i, j in zip(at[lo].tolist(), at[hi + words].tolist(), strict=True)])
                order = np.argsort(h, kind="stable")
                h, name, n = h[order], name[order], n[order]
                new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                low, high = np.minimum.reduceat(name, new), np.maximum.reduceat(name, new)
                yield pa.record_batch(
                    [pa.array(h[new].view(np.int64)), *(pa.array(c[:, i]) for i in (0, 1) for c in (low, high)), pa.array(np.add.reduceat(n, new)), pa.array(np.diff(np.append(new, len(h))))],
                    names=["h", "low_x", "high_x", "low_y", "high_y", "n", "rows"],
                )

    found = rows.mapInArrow(tidy(run), "h long, low_x long, high_x long, low_y long, high_y long, n long, rows long")
    found = found.groupBy("h").agg(*(F.min(f"low_{c}").alias(f"low_{c}") for c in "xy"), *(F.max(f"high_{c}").alias(f"high_{c}") for c in "xy"), F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    return found.where("n > 1").select("h", "rows", F.expr("low_x < high_x OR low_y < high_y").alias("mixed"))


def _places(rows: DataFrame, table, mixed, crowded, words: int, gram: int) -> DataFrame:
    """The places of minimisers in the table: suffixes of those in `mixed`, named passages of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column(1))
                spot, h, lo, hi = w.anchors(words, gram)
                use = in_table(table.value, h)
                spot, h, lo, hi = spot[use], h[use], lo[use], hi[use]
                if not len(h):
                    continue
                data, at = w.joined()
                one, on = _distinct(data, at, w.of[lo], spot, h, lo, hi, words)
                spot, h, lo, hi = spot[one], h[one], lo[one], hi[one]
                text = w.of[lo]
                ids, first = np.asarray(part.column(0))[text], w.first[text]
                differ = in_table(mixed.value, h)
                i = np.flatnonzero(differ)
                after = [data[a:b].decode() for a, b in zip(at[spot[i]].tolist(), at[hi[i] + words].tolist(), strict=True)]
                before = [data[a:b].decode() for a, b in zip(at[lo[i]].tolist(), at[spot[i]].tolist(), strict=True)]
                yield _rows(h=h[i], doc=ids[i], pos=spot[i] - first[i], n=hi[i] - lo[i] + 1, on=on[i], after=after, before=before, least=spot[i] - hi[i], most=spot[i] - lo[i], crowded=in_table(crowded.value, h[i]).astype(np.int64))
                i = np.flatnonzero(~differ)
                name = digests([data[a:b] for a, b in zip(at[lo[i]].tolist(), at[hi[i] + words].tolist(), strict=True)])
                yield _rows(h=h[i], x=name[:, 0], y=name[:, 1], doc=ids[i], pos=lo[i] - first[i], n=hi[i] - lo[i] + 1, on=on[i])

    return rows.mapInArrow(tidy(run), _PLACE)


_SCHEMA = [(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in _PLACE.split(", ")]
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]
_NONE = np.iinfo(np.int64).max


def _rows(**columns) -> pa.RecordBatch:
    n = len(columns["doc"])
    columns["h"] = columns["h"].view(np.int64)
    return pa.record_batch([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _SCHEMA], names=[c for c, _ in _SCHEMA])


def _found(*columns) -> pa.RecordBatch:
    size = next(len(c) for c in columns if c is not None)
    return pa.record_batch([pa.nulls(size, pa.int64()) if c is None else c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names=_NAMES)


def _as_they_are(h, x, y, doc, pos, n, step, on) -> pa.RecordBatch:
    return _found(doc, pos, None, None, None, None, h, x, y, n, step, on)


def _together(doc, pos, n, gone, other, words: int) -> pa.RecordBatch:
    """Windows one after the other, with the same to tell, as one row."""
    order = np.lexsort((pos, gone, other, doc))
    doc, pos, stop, gone, other = doc[order], pos[order], (pos + n + (words - 1))[order], gone[order], other[order]
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (gone[1:] != gone[:-1]) | (other[1:] != other[:-1]) | (pos[1:] > stop[:-1])
    at = np.flatnonzero(head)
    stop = np.maximum.reduceat(stop, at)
    doc, pos, gone, other = doc[at], pos[at], gone[at], other[at]
    return _found(doc, pos, stop, pos, np.where(gone, stop, pos), pa.array(other, pa.int64(), mask=other == _NONE), None, None, None, None, None, None)


def _with_copies(doc, pos, n, step, on, gone, other, words: int) -> pa.RecordBatch:
    """As `_together`, of n windows each and the same again at each `step` words further on, up to `on`: these have an earlier place."""
    more = ~gone & (on > 0)
    both = lambda x, y: np.concatenate([x, y[more]])
    return _together(both(doc, doc), both(pos, pos + step), both(np.where(gone, n + on, n), n + on - step), both(gone, ~gone), both(other, other), words)


def _heads(*columns) -> np.ndarray:
    """Where a new value of the columns begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _told_of_runs(new: np.ndarray, doc: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs (beginning at `new`) of equal windows, each sorted by (doc, pos): which rows have company; of those, if an earlier
    one has the window (gone) and the smallest other document with it."""
    size = np.diff(np.append(new, len(doc)))
    several = (size > 1) | (on[new] > 0)
    keep = np.repeat(several, size)
    doc, size = doc[keep], size[several]
    if not len(size):
        return keep, np.zeros(0, bool), doc
    new = np.cumsum(size) - size
    run = np.repeat(np.arange(len(size)), size)
    least = doc[new]
    second = np.minimum.reduceat(np.where(doc != least[run], doc, _NONE), new)
    gone = np.ones(len(doc), bool)
    gone[new] = False
    return keep, gone, np.where(doc != least[run], least[run], second[run])


def common_beginnings(number: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """LCP: with how many words (`size` numbers from `first` on) each row begins like the one before it."""
    n = len(first)
    out = np.zeros(n, np.int64)
    same = np.arange(1, n)
    for d in range(int(size.max()) if n else 0):
        same = same[(size[same] > d) & (size[same - 1] > d)]
        same = same[number[first[same] + d] == number[first[same - 1] + d]]
        if not len(same):
            break
        out[same] += 1
    return out


def suffix_windows(h, doc, pos, after: pa.Array, before: pa.Array, least, most, on, words: int, more_before: bool, more_after: bool) -> Iterator[pa.RecordBatch]:
    """The windows that rows of suffixes, sorted by (h, after, doc, pos), have in common. If rows may go on before or after these,
    the windows of the interval at that end come as they are, named."""
    n = len(h)
    both = Words(pa.concat_arrays([after, before]))
    number, at = both.numbers(), both.first
    right, left = np.diff(at)[:n], np.diff(at)[n:]
    lcp = common_beginnings(number, at[:n], right)
    lcp[_heads(h)] = -1
    # left: a name for the o words before each suffix, for each o in turn
    back, ends, open_rows, step = np.zeros(n, np.int64), at[n + 1 :], [], most - least + 1
    for o in range(int(most.max()) + 1 if n else 0):
        if o:
            word = np.where(left >= o, number[np.maximum(ends - o, 0)], -1)
            _, back = np.unique(back * (len(number) + 2) + word + 1, return_inverse=True)
        interval = np.cumsum(lcp < words - o)
        use = (least <= o) & (o <= most)
        cut = use & (more_before & (interval == interval[0]) | more_after & (interval == interval[-1]))
        open_rows.append(np.stack([np.flatnonzero(cut), np.full(int(cut.sum()), o)]))
        i = np.flatnonzero(use & ~cut)
        if not len(i):
            continue
        begin = pos[i] - o
        order = np.lexsort((begin, doc[i], back[i], interval[i]))
        i, begin = i[order], begin[order]
        keep, gone, other = _told_of_runs(_heads(interval[i], back[i]), doc[i], on[i])
        if len(gone):
            i = i[keep]
            yield _with_copies(doc[i], begin[keep], 1, step[i], on[i], gone, other, words)
    i, o = np.concatenate(open_rows, axis=1) if open_rows else np.zeros((2, 0), np.int64)
    if len(i):
        data, byte = both.joined()
        name = digests([data[a:b] + data[c:d] for a, b, c, d in zip(byte[ends[i] - o].tolist(), byte[ends[i]].tolist(), byte[at[i]].tolist(), byte[at[i] + words - o].tolist(), strict=True)])
        yield _as_they_are(h[i], name[:, 0], name[:, 1], doc[i], pos[i] - o, np.ones(len(i), np.int64), step[i], on[i])


def _suffixes(words: int, longest: int, together: int):
    """Of sorted suffixes: the windows that others have too, as in `repeated_passages`, and named windows of intervals that
    another task, or another part of a very long run of one minimiser, may have rows of."""

    def whole(rows: list, more_before: bool, more_after: bool) -> Iterator[pa.RecordBatch]:
        found, crowded = [], rows[7]
        for out in suffix_windows(*rows[:7], rows[8], words, more_before and crowded[0] == 1, more_after and crowded[-1] == 1):
            if out.column("x").null_count:
                found.append(out)
            else:
                yield out
        if found:
            t = pa.Table.from_batches(found).combine_chunks()
            doc, begin, stop, gone = (t.column(c).to_numpy() for c in ("doc", "begin", "stop", "gone_stop"))
            other = t.column("other").fill_null(_NONE).to_numpy()
            yield _together(doc, begin, stop - begin - (words - 1), gone > begin, other, words)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        count, more_before = 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(i) if i in (3, 4) else batch.column(i).to_numpy(zero_copy_only=False) for i in range(9)])
            count += batch.num_rows
            if count < together:
                continue
            rows = [pa.concat_arrays(c) if i in (3, 4) else np.concatenate(c) for i, c in enumerate(zip(*held, strict=True))]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # whole minimisers, but for one with very many rows
            long = not cut and count >= longest
            cut = count if long else cut
            if cut:
                yield from whole([c[:cut] for c in rows], more_before, long)
                more_before = long
            held, count = [[c[cut:] for c in rows]], count - cut
        if count:
            yield from whole([pa.concat_arrays(c) if i in (3, 4) else np.concatenate(c) for i, c in enumerate(zip(*held, strict=True))], more_before, True)

    return task


def _runs(words: int, longest: int):
    """Of sorted named places: what other places have too, as in `repeated_passages`. Places of runs that may go on in another task,
    and of very long ones, come as they are, with h."""

    def whole(rows: list[np.ndarray], first: bool) -> Iterator[pa.RecordBatch]:
        """Complete runs; the first of the task may be incomplete."""
        new = _heads(*rows[:3])
        if first:
            size = int(new[1]) if len(new) > 1 else len(rows[0])
            yield _as_they_are(*(x[:size] for x in rows))
            rows, new = [x[size:] for x in rows], new[1:] - size
        if not len(new):
            return
        keep, gone, other = _told_of_runs(new, rows[3], rows[7])
        if len(gone):
            yield _with_copies(*(x[keep] for x in rows[3:]), gone, other, words)

    def last_run(rows: list[np.ndarray]) -> int:
        cut = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in rows[:3]]))
        return int(cut[-1]) + 1 if len(cut) else 0

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count, first = 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(8)])
            count += batch.num_rows
            if count < longest:  # so many at a time, that windows of one passage are met together
                continue
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = last_run(rows)
            if cut:
                yield from whole([x[:cut] for x in rows], first)
                first = False
            held = [[x[cut:] for x in rows]]
            count -= cut
            if count >= longest:  # a very long run; what is still to come of it goes the same way
                yield _as_they_are(*(x[:-1] for x in held[0]))
                held, count, first = [[x[-1:] for x in held[0]]], 1, True
        if count:
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = last_run(rows)
            if cut:
                yield from whole([x[:cut] for x in rows], first)
            yield _as_they_are(*(x[cut:] for x in rows))

    return task


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run in a batch of places (x, y, doc, pos, on): its first and last place, and its second document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y, doc, pos, on = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        order = np.lexsort((pos, doc, y, x))
        x, y, doc, pos, on = x[order], y[order], doc[order], pos[order], on[order]
        new = _heads(x, y)
        size = np.diff(np.append(new, len(x)))
        last = new + size - 1
        second = np.minimum.reduceat(np.where(doc != np.repeat(doc[new], size), doc, _NONE), new)
        yield pa.record_batch([pa.array(c) for c in (x[new], y[new], doc[new], pos[new], doc[last], pos[last] + on[last], second)], names=["x", "y", "doc", "pos", "last_doc", "last_pos", "second"])


def _told(least, words: int):
    """As `_runs`, of places (x, y, doc, pos, n, step, on) whose runs' first place and second document are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, doc, pos, n, step, on = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            new = _heads(x, y)
            found = [least.value.get(k) for k in zip(x[new].tolist(), y[new].tolist(), strict=True)]
            size = np.diff(np.append(new, len(x)))
            keep = np.repeat([k is not None for k in found], size)
            if not keep.any():
                continue
            first, at, second = (np.repeat([k[i] if k else 0 for k in found], size)[keep] for i in range(3))
            doc, pos, n, step, on = doc[keep], pos[keep], n[keep], step[keep], on[keep]
            yield _with_copies(doc, pos, n, step, on, (doc != first) | (pos != at), np.where(doc != first, first, second), words)

    return run


def repeated_passages(docs: DataFrame, words: int = WORDS, gram: int = GRAM, longest: int = LONG, together: int = TOGETHER, crowded: int = LONG) -> DataFrame:
    """doc, begin, stop (words of it that another place has too), gone_begin, gone_stop (the part that an earlier document,
    or an earlier place of this one, has; empty if none) and other (the smallest other document with them)."""
    spark = docs.sparkSession
    h = WorkTable(_minimisers(docs, words, gram), "minimisers").read()
    places = WorkTable(_places(docs, bit_table(h), bit_table(h.where("mixed")), bit_table(h.where(F.col("rows") > crowded)), words, gram), "places").read()
    order = ["h", "after", "doc", "pos"]
    suffixes = places.where("after IS NOT NULL").select("h", "doc", "pos", "after", "before", "least", "most", "crowded", "on")
    dealt = suffixes.repartitionByRange(partitions(spark), "h", *(F.when(F.col("crowded") == 1, F.col(c)) for c in order[1:]))
    met = WorkTable(dealt.sortWithinPartitions(*order).mapInArrow(tidy(_suffixes(words, longest, together)), _FOUND), "suffixes").read()
    order = ["h", "x", "y", "doc", "pos"]
    named = places.where("x IS NOT NULL").select(*order, "n", F.col("n").alias("step"), "on").unionByName(met.where("x IS NOT NULL").select("h", "x", "y", "doc", F.col("begin").alias("pos"), "n", "step", "on"))
    runs = WorkTable(named.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(tidy(_runs(words, longest)), _FOUND), "runs").read()
    rest = runs.where("x IS NOT NULL").select("x", "y", "doc", F.col("begin").alias("pos"), "n", "step", "on")
    ends = WorkTable(rest.select("x", "y", "doc", "pos", "on").mapInArrow(tidy(_ends), "x long, y long, doc long, pos long, last_doc long, last_pos long, second long"), "ends").read()
    led = ends.groupBy("x", "y").agg(F.min(F.struct("doc", "pos")).alias("least"), F.max(F.struct("last_doc", "last_pos")).alias("most")).where("least.doc <> most.last_doc OR least.pos <> most.last_pos")
    second = F.min(F.when(F.col("doc") == F.col("least.doc"), F.col("second")).otherwise(F.col("doc")))
    # two keys a task, one for each LONG rows
    known = ends.join(F.broadcast(led), ["x", "y"]).groupBy("x", "y").agg(F.min("least").alias("least"), second.alias("second")).collect()
    least = spark.sparkContext.broadcast({(r["x"], r["y"]): (r["least"]["doc"], r["least"]["pos"], r["second"]) for r in known})
    across = rest.mapInArrow(tidy(_told(least, words)), _FOUND)
    return met.where("x IS NULL").unionByName(runs.where("x IS NULL")).unionByName(across).select("doc", "begin", "stop", "gone_begin", "gone_stop", "other")


#: Sorted spans, those that overlap or touch as one.
_UNITED = "aggregate({0}, cast(array() AS array<struct<begin:bigint,stop:bigint>>), (a, x) -> IF(size(a) = 0 OR x.begin > element_at(a, -1).stop, array_append(a, x), array_append(slice(a, 1, size(a) - 1), struct(element_at(a, -1).begin AS begin, greatest(element_at(a, -1).stop, x.stop) AS stop))))"


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """Each document (`id_col`) with n_words, spans (struct(begin, stop) of words that repeat elsewhere, in passages of so
    many words at least), gone (of those, what an earlier document or place has, to be removed), n_repeated, n_removed
    and others (ids of documents that share a passage: of each place the smallest one).

    Words are parted by blanks and not changed otherwise. Null and empty texts have none; a text of fewer words than a
    passage has no spans. Rows without an id get no row, rows that repeat an id count as one document, other columns play
    no part; an empty table gives an empty result.
    """
    short_batches(docs.sparkSession)
    rows = documents_of(docs, id_col, text_col)
    met = repeated_passages(rows, words, gram).groupBy("doc").agg(
        F.array_sort(F.collect_set(F.struct("begin", "stop"))).alias("spans"),
        F.array_sort(F.collect_set(F.when(F.col("gone_begin") < F.col("gone_stop"), F.struct(F.col("gone_begin").alias("begin"), F.col("gone_stop").alias("stop"))))).alias("gone"),
        F.array_sort(F.collect_set("other")).alias("others"),
    )
    met = met.select("doc", F.expr(_UNITED.format("spans")).alias("spans"), F.expr(_UNITED.format("gone")).alias("gone"), "others")
    n = rows.select("doc", F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).cast("long").alias("n_words"))
    none = F.expr("cast(array() AS array<struct<begin:bigint,stop:bigint>>)")
    out = n.join(met, "doc", "left").select(F.col("doc").alias(id_col), "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("gone", none).alias("gone"), F.coalesce("others", F.expr("cast(array() AS array<bigint>)")).alias("others"))
    total = "aggregate({0}, 0L, (a, x) -> a + x.stop - x.begin)"
    return out.withColumn("n_repeated", F.expr(total.format("spans"))).withColumn("n_removed", F.expr(total.format("gone")))


def without_passages(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the words in `gone` of `suffix_dedup` removed; a text that loses words has its words joined by one blank."""
    gone = found.where("size(gone) > 0").select(F.col(id_col).alias("__id"), F.col("gone").alias("__gone"))
    w = f"regexp_extract_all({text_col}, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)"
    stay = F.expr(f"array_join(filter({w}, (x, i) -> NOT exists(__gone, g -> i >= g.begin AND i < g.stop)), ' ')")
    both = docs.join(gone, docs[id_col] == gone["__id"], "left")
    return both.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(stay)).drop("__id", "__gone")
