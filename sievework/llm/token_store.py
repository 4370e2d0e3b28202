"""A content-addressed store of token ids.

A rolling hash over the ids cuts each document into chunks, so equal passages give equal chunks wherever they stand. A
chunk's address is the BLAKE2b digest of its ids. Each distinct chunk is stored once, with the first document that has it;
other documents refer to it. A document's recipe lists the addresses of its chunks, and the root over them (a Merkle tree's)
is checked, with every chunk's digest, when it is read.

The store is a folder of Parquet: `documents`, in parts by ascending id, each row a recipe with the chunks that are at home
there (packed with zstd; ids of two bytes where the vocabulary allows, else four); and `manifest`, a row for each part:
how many ids come before it, how many it has, and the root over its documents' roots.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import WorkTable, documents_of, partitions, short_batches, slices, tidy
from .tokens import encoder, largest_id

#: A chunk ends where the hash of its last ids has this many bits zero, after so many ids at least, or at the most.
SPAN, BITS, LEAST, MOST = 8, 10, 256, 4096


def cuts(ids: np.ndarray, at: list[int]) -> list[list[int]]:
    """Where chunks of documents end, of each from its begin on; document d has the ids from at[d] to at[d + 1]. This depends on
    the ids about a cut alone, but for the least and most lengths."""
    roll = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    j = 1
    while j < SPAN:  # ids j places before count with the multiplier's power j; a document's first SPAN ids make no cut
        roll[j:] += roll[:-j] * np.uint64(pow(0xD1342543DE82EF95, j, 1 << 64))
        j *= 2
    roll ^= roll >> np.uint64(32)
    ends = np.flatnonzero((roll & np.uint64((1 << BITS) - 1)) == 0) + 1
    of, out = np.searchsorted(ends, at, "right").tolist(), []
    ends = ends.tolist()
    for d, (begin, end) in enumerate(zip(at, at[1:])):
        n, last, own = end - begin, 0, []
        if n > LEAST:
            for e in (x - begin for x in ends[of[d] : of[d + 1]]):
                while e - last > MOST:
                    last += MOST
                    own.append(last)
                if e - last >= LEAST:
                    own.append(e)
                    last = e
            while n - last > MOST:
                last += MOST
                own.append(last)
        if n > last:
            own.append(n)
        out.append(own)
    return out


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=20).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary tree over the leaves; one without a partner goes up as it is."""
    level = [digest(b"\x00" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\x01" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


_CHUNKS = pa.list_(pa.binary())


def _chunks(path: str, kind: str, end_id: int, width: int):
    """doc, n, addresses and packed chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, pack = encoder(path, kind), zstandard.ZstdCompressor(level=1, write_content_size=True)
        for part in (p for b in batches for p in slices(b, 1 << 21)):
            addresses, packed = [], []
            end = np.array([end_id], f"<u{width}")
            ids = [x for i in e.encode(part.column(1)) for x in (i, end)]
            n = [len(i) + 1 for i in ids[::2]]
            ids = np.concatenate(ids).astype(f"<u{width}")
            data, at = ids.tobytes(), [0, *itertools.accumulate(n)]
            for begin, ends in zip(at, cuts(ids, at)):
                chunks = [data[(begin + i) * width : (begin + j) * width] for i, j in zip([0, *ends], ends)]
                addresses.append([digest(x) for x in chunks])
                packed.append([pack.compress(x) for x in chunks])
            yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(addresses, _CHUNKS), pa.array(packed, _CHUNKS)], names=["doc", "n", "addresses", "packed"])

    return run


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by document, for each what is said of its chunks (kind 0) and then the chunks (kind 1): its recipe,
    with the chunks that are at home here. before is how many ids of the part come before it."""
    from pyspark import TaskContext

    part, before, away, shared = TaskContext.get().partitionId(), 0, [], []
    for batch in batches:
        out = []
        for doc, kind, n, a, p, places, home in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if kind == 0:
                away, shared = (places or [], home or [])
                continue
            gone = set(away)
            out.append((part, doc, before, n, a, [None if i in gone else x for i, x in enumerate(p)], sorted(shared), merkle(a)))
            before += n
            away, shared = [], []
        if out:
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), _CHUNKS, _CHUNKS, pa.list_(pa.int32()), pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["part", "doc", "before", "n", "addresses", "packed", "shared", "root"])


def write(docs: DataFrame, folder: str, tokenizer: str, kind: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", width: int | None = None) -> None:
    """Writes the ids of all texts, with end_id after each, as a store in the folder (which must not be there yet).

    tokenizer is the path of a vocabulary's file, which the executors read; kind as in `tokens.Encoder`; width the bytes of an
    id (2 or 4; by the vocabulary if not given), and an error if its largest id needs more. Null and empty texts have the end id alone. Rows without an id are left out, rows that repeat one count as one
    document; other columns play no part; an empty table gives a store without documents.
    """
    spark = docs.sparkSession
    short_batches(spark)
    least = 2 if max(largest_id(tokenizer), end_id) < 1 << 16 else 4
    if width not in (None, 2, 4) or (width or 4) < least:
        raise ValueError(f"the vocabulary's ids need {least} bytes")
    width = width or least
    staged = WorkTable(documents_of(docs, id_col, text_col).mapInArrow(tidy(_chunks(tokenizer, kind, end_id, width)), "doc long, n long, addresses array<binary>, packed array<binary>"), "encoded")
    rows = staged.read()
    chunk = rows.select("doc", F.posexplode("addresses").alias("place", "address"))
    # of an address that is found twice the first place is its home
    homes = WorkTable(chunk.groupBy("address").agg(F.min(F.struct("doc", "place")).alias("home"), F.count("*").alias("n")).where("n > 1").select("address", "home"), "homes")
    again = chunk.join(homes.read(), "address").withColumn("at_home", F.struct("doc", "place") == F.col("home"))
    said = again.groupBy("doc").agg(F.collect_list(F.when(~F.col("at_home"), F.col("place"))).alias("away"), F.collect_list(F.when(F.col("at_home"), F.col("place"))).alias("shared"))
    none = F.lit(None)
    both = said.select("doc", F.lit(0).alias("kind"), none.cast("long").alias("n"), none.cast("array<binary>").alias("addresses"), none.cast("array<binary>").alias("packed"), "away", "shared").unionByName(
        rows.select("doc", F.lit(1).alias("kind"), "n", "addresses", "packed", none.cast("array<int>").alias("away"), none.cast("array<int>").alias("shared"))
    )
    # a document's two rows stay together as both have its id, by which alone the rows are dealt
    dealt = both.repartitionByRange(partitions(spark), "doc").sortWithinPartitions("doc", "kind")
    schema = "part int, doc long, before long, n long, addresses array<binary>, packed array<binary>, shared array<int>, root binary"
    dealt.mapInArrow(tidy(_stored), schema).write.option("compression", "none").parquet(f"{folder}/documents")
    parts = spark.read.schema(schema).parquet(f"{folder}/documents").select("part", "doc", "n", "root")
    sums = parts.groupBy("part").agg(F.min("doc").alias("first_doc"), F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc", "root"))), lambda x: F.hex(x["root"])), ""), 256).alias("root"))
    got = sorted(sums.select("part", "first_doc", "n", "root").collect())  # a row a part
    start, lines = 0, []
    for part, first, n, root in got:
        lines.append((part, first, start, n, root))
        start += n
    spark.createDataFrame(lines, "part int, first_doc long, start long, n long, root string").coalesce(1).write.parquet(f"{folder}/manifest")
    homes.drop()
    staged.drop()


def read(spark: SparkSession, folder: str, per_document, schema: str) -> DataFrame:
    """A row for each document of the store: doc, start (how many ids come before it), n_tokens, and what per_document makes of
    its ids (little-endian unsigned, bytes) and their width; schema is that of these further columns.

    Every chunk is checked against its address and every recipe against its root; a mismatch fails the read.
    """
    stored = spark.read.parquet(f"{folder}/documents")
    starts = F.broadcast(spark.read.parquet(f"{folder}/manifest").select("part", "start"))  # a row a part
    heads = stored.select("part", "doc", "before", "n", "addresses", "packed", "root")
    whole = F.forall("packed", lambda x: x.isNotNull())
    home = stored.where(F.size("shared") > 0).select(F.explode("shared").alias("i"), "addresses", "packed").select(F.get("addresses", "i").alias("address"), F.get("packed", "i").alias("chunk"))
    short = heads.where(~whole).select("part", "doc", "before", "n", "root", F.posexplode(F.arrays_zip("addresses", "packed")).alias("place", "x"))
    short = short.select("part", "doc", "before", "n", "root", "place", F.col("x.addresses").alias("address"), F.col("x.packed").alias("chunk"))
    fetched = short.where("chunk IS NULL").drop("chunk").join(home, "address").select(*short.columns)
    gathered = short.where("chunk IS NOT NULL").unionByName(fetched).groupBy("part", "doc", "before", "n", "root").agg(F.array_sort(F.collect_list(F.struct("place", "address", "chunk"))).alias("x"))
    gathered = gathered.select("part", "doc", "before", "n", F.col("x.address").alias("addresses"), F.col("x.chunk").alias("packed"), "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for part, doc, before, n, addresses, packed, root in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                chunks = [unpack.decompress(x) for x in packed]
                if [digest(x) for x in chunks] != addresses or merkle(addresses) != root:
                    raise ValueError(f"document {doc} of the store is damaged")
                out.append((part, doc, before, n, *per_document(b"".join(chunks), n)))
            if out:
                yield pa.record_batch([pa.array(c, pa.int32() if i == 0 else None) for i, c in enumerate(zip(*out, strict=True))], names=["part", "doc", "before", "n", *names])

    names = [x.split()[0] for x in schema.split(", ")]
    found = heads.where(whole).unionByName(gathered).mapInArrow(tidy(run), f"part int, doc long, before long, n long, {schema}")
    return found.join(starts, "part").select("doc", (F.col("start") + F.col("before")).alias("start"), F.col("n").alias("n_tokens"), *names)


def crc_of(data: bytes, n: int) -> tuple[int]:
    """crc32 of n ids as little-endian unsigned 32-bit integers."""
    return (zlib.crc32(np.frombuffer(data, f"<u{len(data) // n}").astype("<u4").tobytes()),)
