"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then a check of the Hamming distance.

`simhash_components` is exact: all fingerprints within the distance are linked. A fingerprint's bits are cut into blocks;
two that differ in few bits agree in some combination of whole blocks, which is the key rows are sorted by. Equal
fingerprints are one row before that, so copies cost nothing. Runs of one key are compared pair by pair while short. A
run that is long, or that a task's border may have cut, is handled another way, exact too: each of its fingerprints is
put under all values within half the distance of it (only bits outside the key differ). Two under one value are within
the distance of each other, and each pair within the distance meets under a value between them; so the smallest of a
value is linked with the rest, and rows stay in proportion to the input, however many there are in a group.

`near_duplicates` finds similar texts (Jaccard similarity of word shingles of 0.8 or more), where a 64-bit fingerprint
is too coarse: wide fingerprints cut into blocks of 20 bits, each a key. See there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import WorkTable, digests, documents_of, materialize, partitions, short_batches, tidy
from .components import components

#: A-Z as a-z, byte by byte.
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
SEED = 42


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of the text's shingles, repeats included: runs of so many words (parted by blanks, A-Z lower-cased), joined
    by one blank; of fewer words the whole sequence is the only one, and of none there is none."""
    w = text.encode().translate(_LOWER).split() if text else []  # bytes.split() parts at U+0009 to U+000D and blanks
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    digest, seed = xxhash.xxh64_intdigest, SEED
    if len(w) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    size = np.fromiter(map(len, w), np.int64, len(w)) + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    return np.array([digest(joined[s:e], seed) for s, e in zip(start[: len(w) - words + 1].tolist(), end[words - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes; zero of none."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc and fp (the 64 bits as a long) of each document."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(shingle_hashes(t.as_py(), words)) for t in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], names=["doc", "fp"])

    return documents_of(docs, id_col, text_col).mapInArrow(tidy(run), "doc long, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """The masks of all combinations of whole blocks of 64 bits that stay equal when so many blocks differ."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(one, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(mask: int, bits: int) -> np.ndarray:
    """All values of up to so many bits outside the mask."""
    free = [1 << i for i in range(64) if not mask >> i & 1]
    return np.array([sum(c) for n in range(bits + 1) for c in combinations(free, n)], np.uint64)


def _compare(masks: list[int], distance: int, longest: int):
    """Of rows (kind, key, fp, rep) sorted by kind, key and rep: the links found in short whole runs, as (a, b), and the
    rows of the other runs under the values between, as (kind, value, rep)."""
    flips = [_flips(m, (distance + 1) // 2) for m in masks]

    def out(a, b, kind=None, value=None) -> pa.RecordBatch:
        n = len(a)
        none = pa.nulls(n, pa.int64())
        return pa.record_batch([pa.array(a, pa.int64()), none if b is None else pa.array(b, pa.int64()), none if kind is None else pa.array(kind, pa.int64()), none if value is None else pa.array(value, pa.int64())], names=["a", "b", "kind", "value"])

    def between(kind, fp, rep) -> Iterator[pa.RecordBatch]:
        for k in np.unique(kind):
            mine = kind == k
            f, r, x = fp[mine], rep[mine], flips[int(k)]
            for i in range(0, len(f), 4096):
                v = f[i : i + 4096, None] ^ x[None, :]
                yield out(np.repeat(r[i : i + 4096], len(x)), None, np.full(v.size, k), v.ravel().view(np.int64))

    def whole(kind, key, fp, rep, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        """Rows of complete runs; the first or last run of the task may be incomplete."""
        new = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])]))
        size = np.diff(np.append(new, len(key)))
        other = size > longest
        if first:
            other[0] = True
        if last:
            other[-1] = True
        run = np.repeat(np.arange(len(new)), size)
        far = other[run]
        yield from between(kind[far], fp[far], rep[far])
        keep = ~far & (size > 1)[run]
        fp, rep, run = fp[keep], rep[keep], run[keep]
        for step in range(1, longest):
            if len(run) <= step:
                break
            i = np.flatnonzero(run[step:] == run[:-step])
            if not len(i):
                break
            near = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= distance]
            if len(near):
                yield out(rep[near], rep[near + step])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            rows[2] = rows[2].view(np.uint64)
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            cut = len(same) - int(same[::-1].argmin() if not same.all() else len(same))
            if cut:
                yield from whole(*(x[:cut] for x in rows), first, False)
                first = False
            held = [x[cut:] for x in rows]
            if len(held[0]) > 100_000:  # a very long run: what is held of it is under its values between already
                yield from between(held[0], held[2], held[3])
                held = [x[-1:] for x in held]
                first = True  # the rest of that run goes the same way
        if held is not None:
            yield from whole(*held, first, True)

    return task


def links(fps: DataFrame, distance: int = 2, blocks: int = 5, longest: int = 64) -> DataFrame:
    """Links (a, b) between reps of distinct fingerprints (fp, rep) whose components are those of all pairs within the
    distance (1 or 2 bits)."""
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2: only then are two values near one between them within the distance")
    spark = fps.sparkSession
    masks = block_masks(blocks, distance)
    keys = F.array(*(F.struct(F.lit(i).cast("long").alias("kind"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)))
    keyed = fps.select(F.explode(keys).alias("k"), "fp", "rep").select("k.kind", F.xxhash64("k.key").alias("spread"), "k.key", "fp", "rep")
    dealt = keyed.repartitionByRange(partitions(spark), "kind", "spread", "rep").sortWithinPartitions("kind", "spread", "key", "rep").select("kind", "key", "fp", "rep")
    found = materialize(dealt.mapInArrow(tidy(_compare(masks, distance, longest)), "a long, b long, kind long, value long"), "near")
    far = found.where("value IS NOT NULL").select("kind", "value", F.col("a").alias("rep"))
    least = materialize(far.groupBy("value").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("value", "least"), "between")
    star = far.select("value", "rep").join(least, "value").where("rep > least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    return found.where("value IS NULL").select("a", "b").unionByName(star)


def simhash_components(docs: DataFrame, words: int = 3, distance: int = 2, blocks: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document (`id_col`) with fingerprint (16 hex digits) and component_id, the smallest id reachable over links.

    Texts without words, null and empty ones among them, have fingerprint zero and are linked like any other. Rows without
    an id get no row, rows that repeat an id count as one document; other columns play no part. Documents of equal
    fingerprints are linked through the smallest of them.
    """
    fp = materialize(fingerprints(docs, words, id_col, text_col), "fingerprints")
    reps = materialize(fp.groupBy("fp").agg(F.min("doc").alias("rep")), "reps")
    comp = components(links(reps, distance, blocks))
    of = materialize(reps.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "components")
    return fp.join(of, "fp").select(F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- similar texts -----------------------------------------------------------------------------------------------------

#: Shingles of so many words and the least Jaccard similarity of two texts' sets of them.
SHINGLE, SIMILARITY = 5, 0.8
#: A wide fingerprint: so many blocks of so many bits, and 192 bits to compare.
BLOCKS, BLOCK_BITS, SKETCH = 96, 20, 192
#: Blocks are joined in turns of so many; pairs that earlier turns have put in one group aren't compared again.
TURNS = (6, 30, 60)
#: Bits of the 192 that may differ: similar texts of 0.8 differ in 29 on average, with a deviation of 5.
FAR = 44
#: Bits of a map of ids for each of them, and at most (8 MiB, which are broadcast), in pieces of so many.
MAP_BITS, MAP_MOST, MAP_PIECE = 16, 1 << 26, 1 << 15
_WORDS = -(-(BLOCKS * BLOCK_BITS + SKETCH) // 64)
_SKETCH = [f"s{i}" for i in range(SKETCH // 64)]


def _sign_words() -> list[np.ndarray]:
    rng = np.random.default_rng(1)
    return [rng.integers(0, 1 << 64, (4096, _WORDS), dtype=np.uint64) for _ in range(2)]


def wide_fingerprint(shingles: np.ndarray, signs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The blocks and the bits to compare (as numbers) of a set of shingle hashes (distinct, one at least). All shingles count."""
    count, part = np.zeros(_WORDS * 64, np.int64), 255
    for i in range(0, len(shingles), part):
        x = shingles[i : i + part] * np.uint64(0x9E3779B97F4A7C15)
        w = signs[0][x >> np.uint64(52)] ^ signs[1][(x >> np.uint64(40)) & np.uint64(4095)]
        count += np.add.reduce(np.unpackbits(w.view(np.uint8).reshape(len(x), -1), axis=1), axis=0, dtype=np.uint8)
    bits = count * 2 > len(shingles)
    blocks = bits[SKETCH : SKETCH + BLOCKS * BLOCK_BITS].reshape(BLOCKS, BLOCK_BITS) @ (1 << np.arange(BLOCK_BITS))
    return blocks, np.packbits(bits[:SKETCH]).view(">i8").astype(np.int64)


def _wide(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = _sign_words()
        for batch in batches:
            ids, sketch, blocks, name = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = np.unique(shingle_hashes(text.as_py(), words))
                if len(h):
                    b, s = wide_fingerprint(h, signs)
                    ids.append(doc)
                    sketch.append(s)
                    blocks.append(b.astype(np.int32))
                    name.append(h.tobytes())
            sketch, name = np.array(sketch, np.int64).reshape(-1, len(_SKETCH)), digests(name)
            yield pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(c) for c in (*sketch.T, *name.T)), pa.array(blocks, pa.list_(pa.int32()))], names=["doc", *_SKETCH, "x", "y", "blocks"])

    return docs.mapInArrow(tidy(run), "doc long, " + "".join(f"{c} long, " for c in _SKETCH) + "x long, y long, blocks array<int>")


def _pieces(batches: Iterator[pa.RecordBatch], columns: Callable[[pa.RecordBatch], list]) -> Iterator[list]:
    """The columns of sorted rows in pieces of whole runs; the first column tells runs."""
    held: list[list] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = columns(batch)
        cut = int(np.searchsorted(rows[0], rows[0][-1]))  # a run that goes on is held
        if cut or (held and held[-1][0][-1] != rows[0][0]):
            held.append([x[:cut] for x in rows])
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, rows = [], [x[cut:] for x in rows]
        held.append(rows)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _near_others(sketch: np.ndarray, grp: np.ndarray, far: int) -> np.ndarray:
    """Which rows have a near sketch in another group."""
    n = len(grp)
    found, todo, step = np.zeros(n, bool), np.arange(n), max(1, (1 << 18) // max(n, 1))
    while len(todo):
        some, todo = todo[:step], todo[step:]
        close = (np.bitwise_count(sketch[some, None] ^ sketch).sum(axis=-1, dtype=np.int64) <= far) & (grp[some, None] != grp)
        found[some] |= close.any(axis=1)
        found |= close.any(axis=0)
        todo = todo[~found[todo]]
    return found


def _near_rows(far: int, short: int = 16):
    """Of rows (key, sketch, rep, grp) sorted by key and rep: those with a near sketch of another group in their run, once each,
    with the first rep that this task has of the run (part)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns(batch: pa.RecordBatch) -> list:
            key, *sketch, rep, grp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns))
            return [key, np.stack(sketch, 1).view(np.uint64), rep, grp]

        for key, sketch, rep, grp in _pieces(batches, columns):
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(new, len(key)))
            run, found = np.repeat(np.arange(len(new)), size), np.zeros(len(key), bool)
            some = np.flatnonzero((size <= short)[run])
            for step in range(1, short):
                i = np.flatnonzero(run[some[step:]] == run[some[:-step]])
                i, j = some[i], some[i + step]
                i, j = (x[grp[i] != grp[j]] for x in (i, j))
                near = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=-1, dtype=np.int64) <= far
                found[i[near]] = found[j[near]] = True
            for k in np.flatnonzero(size > short).tolist():
                all_of = slice(int(new[k]), int(new[k] + size[k]))
                found[all_of] = _near_others(sketch[all_of], grp[all_of], far)
            i = np.flatnonzero(found)
            if len(i):
                yield pa.record_batch([pa.array(c) for c in (key[i], rep[new[run[i]]], *np.ascontiguousarray(sketch[i].T).view(np.int64), rep[i], grp[i])], names=["key", "part", *_SKETCH, "rep", "grp"])

    return task


def _run_links(rep: np.ndarray, sketch: np.ndarray, grp: np.ndarray, shingles: list[np.ndarray], far: int, similarity: float) -> Iterator[tuple[int, int]]:
    """Links of similar texts between the groups of one run: those of near sketches are compared by their whole sets, unless links
    have made them one group already, so there are fewer links than groups."""
    size = np.fromiter(map(len, shingles), np.int64, len(shingles))
    end = np.cumsum(size)
    _, code = np.unique(np.concatenate(shingles), return_inverse=True)
    mine, grp = np.zeros(int(code.max()) + 1, bool), grp.copy()
    for i in range(len(rep) - 1):
        j = np.flatnonzero(grp[i + 1 :] != grp[i]) + i + 1
        if not len(j) and (grp == grp[0]).all():
            return
        j = j[np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=-1, dtype=np.int64) <= far]
        j = j[np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])]
        if not len(j):
            continue
        own = code[end[i] - size[i] : end[i]]
        mine[own] = True
        first = np.cumsum(size[j]) - size[j]
        shared = np.add.reduceat(mine[np.concatenate([code[end[x] - size[x] : end[x]] for x in j.tolist()])], first, dtype=np.int64)
        mine[own] = False
        j = j[shared >= similarity * (size[i] + size[j] - shared)]
        met, at = np.unique(grp[j], return_index=True)
        if len(met):
            yield from ((int(rep[i]), int(rep[x])) for x in j[at].tolist())
            grp[np.isin(grp, met)] = grp[i]


def _similar(far: int, similarity: float):
    """Of rows (key, part, sketch, rep, grp, shingles) sorted by key and part: the links (a, b) of each part of a run."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns(batch: pa.RecordBatch) -> list:
            key, part, *sketch, rep, grp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns - 1))
            sets = batch.column(batch.num_columns - 1)
            value, at = sets.values.to_numpy(), sets.offsets.to_numpy()
            shingles = np.empty(len(key), object)
            shingles[:] = [value[i:j].copy() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            return [key, part, np.stack(sketch, 1).view(np.uint64), rep, grp, shingles]

        for key, part, sketch, rep, grp, shingles in _pieces(batches, columns):
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
            found = [x for i, j in zip(new.tolist(), [*new[1:].tolist(), len(key)], strict=True) for x in _run_links(rep[i:j], sketch[i:j], grp[i:j], list(shingles[i:j]), far, similarity)]
            if found:
                yield pa.record_batch([pa.array(c) for c in np.array(found, np.int64).T], names=["a", "b"])

    return task


def _perhaps(docs: DataFrame, ids: DataFrame, id_col: str, how: str = "left_semi") -> DataFrame:
    """The rows of docs whose id may be among the ids (a column of that name), or with left_anti those whose id can't be; ids
    aren't null. Texts pass a map of bits in the task that reads them, so that a join moves those of few other rows (6 % of
    them up to 4 million ids; the map grows no further, and more pass)."""
    bits = min(max(MAP_BITS * ids.agg(F.count_distinct(id_col)).first()[0], MAP_PIECE), MAP_MOST)
    at = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(bits))
    place = F.pmod(at, F.lit(MAP_PIECE))
    pieces = ids.select(at.alias("__at")).groupBy(F.shiftright("__at", 15).alias("__piece")).agg(F.bitmap_construct_agg(F.pmod("__at", F.lit(MAP_PIECE))).alias("__map"))
    byte = F.conv(F.hex(F.substring("__map", F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return docs.join(F.broadcast(pieces), (F.shiftright(at, 15) == F.col("__piece")) & (F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1), how)


def _with_shingles(near: DataFrame, docs: DataFrame, words: int) -> tuple[DataFrame, WorkTable]:
    """The rows with the whole set of shingles of their texts, and the table of sets that they are read from."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["doc", "shingles"])

    ids = near.select(F.col("rep").alias("doc")).distinct()
    table = WorkTable(_perhaps(docs, ids, "doc").join(ids, "doc", "left_semi").mapInArrow(tidy(sets), "doc long, shingles array<long>"), "shingles")
    return near.join(table.read().withColumnRenamed("doc", "rep"), "rep").select(*near.columns, "shingles"), table


def near_duplicates(docs: DataFrame, words: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and component_id (the smallest id of its group) of each document that has a near-duplicate; others aren't in it.

    Two texts are near-duplicates if the Jaccard similarity of their sets of word shingles is at least `similarity`; groups
    are the connected components. Texts with equal sets are one row. Wide SimHash fingerprints of all shingles propose pairs:
    texts of similarity 0.8 agree in a given block of 20 bits with probability 0.037 and in one of 96 with 0.97; of 0.85 with
    0.998. Rows are sorted by block; in each run of equal blocks, rows that have a near sketch of another group go on with
    their whole sets of shingles, once each, and the task that gets a run compares them. It tells links between groups only, and
    compares nothing that links have made one group, so its rows are fewer than those of the run, however many pairs are near:
    pairs are not rows anywhere. Blocks are joined in turns: what earlier turns have found to be one group isn't compared
    again. Parts of a run that tasks part are not compared with one another in that block.

    Texts without words have no near-duplicates; texts shorter than a shingle are compared as a whole. Rows without an id are
    left out, rows that repeat an id count as one document, other columns play no part; an empty table has no groups.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = documents_of(docs, id_col, text_col)
    wide = WorkTable(_wide(rows, words), "wide").read()
    reps = materialize(wide.groupBy("x", "y").agg(F.min("doc").alias("rep"), F.count("*").alias("n")), "wide-reps")
    found = wide.select("doc", "x", "y").join(reps.where("n > 1"), ["x", "y"]).where("doc <> rep").select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    similar, groups, first = None, None, 0
    columns = ["key", *_SKETCH, "rep", "grp"]
    for turn in TURNS:
        # only this turn's blocks are moved
        heads = wide.select(F.col("doc").alias("rep"), *_SKETCH, F.slice("blocks", first + 1, turn).alias("blocks")).join(reps.select("rep"), "rep", "left_semi")
        of = heads if groups is None else heads.join(groups.select(F.col("id").alias("rep"), F.col("component").alias("grp")), "rep", "left")
        of = of.select("rep", *_SKETCH, (F.col("rep") if groups is None else F.coalesce("grp", "rep")).alias("grp"), F.posexplode("blocks").alias("block", "bits"))
        keyed = of.select((F.col("bits").cast("long") * BLOCKS + F.col("block") + first).alias("key"), *_SKETCH, "rep", "grp")
        first += turn
        dealt = keyed.repartitionByRange(partitions(spark), "key", "rep").sortWithinPartitions("key", "rep").select(*columns)
        near = WorkTable(dealt.mapInArrow(tidy(_near_rows(FAR)), ", ".join(f"{c} long" for c in ("key", "part", *_SKETCH, "rep", "grp"))), "near")
        runs, sets = _with_shingles(near.read(), rows, words)
        runs = runs.repartition(partitions(spark), "key", "part").sortWithinPartitions("key", "part", "rep")
        same = WorkTable(runs.mapInArrow(tidy(_similar(FAR, similarity)), "a long, b long"), "similar").read()
        near.drop()
        sets.drop()
        similar = same if similar is None else similar.unionByName(same)
        groups = materialize(components(similar), "groups")
    return components(found.unionByName(groups.select(F.col("id").alias("a"), F.col("component").alias("b")))).select(F.col("id").alias(id_col), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs but for those with a near-duplicate of a smaller id in their group, with all their columns. Rows without an
    id go."""
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where(F.col(id_col) != F.col("component_id")).select(id_col)
    docs = docs.where(F.col(id_col).isNotNull())
    return _perhaps(docs, gone, id_col, "left_anti").unionByName(_perhaps(docs, gone, id_col).join(gone, id_col, "left_anti").select(*docs.columns))
