"""Exact deduplication by deterministic block naming.

A text, blanks normalised, is cut into blocks of a fixed number of characters. Sorted blocks get integer names, equal
ones the same; adjacent names are paired and the sorted pairs named again, until one name is left for each document.
Names come from comparing contents, so documents have the same name and number of blocks if and only if their texts are
equal: nothing rests on a hash being free of collisions (a hash only orders the rows to sort).

Sorting is by (hash, content, document), dealt by range, so that one block that a third of all rows share spreads over
many tasks; what spans a border between tasks is renamed through a table with a few rows a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import WorkTable, documents_of, materialize, partitions, short_batches, tidy

BLANKS = r"[\x20\x09-\x0D]+"


def normalized(text: str) -> F.Column:
    """Each run of blanks (U+0020, U+0009 to U+000D) as one blank; null as the empty text."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, " ")


_NAMED = "doc long, pos long, blocks long, name long, border string"


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names the sorted rows (h, k, doc, pos, blocks) of one task: its number and a rank. Rows with `border` tell the
    content behind a name where another task may hold the same content."""
    base, rank, last = TaskContext.get().partitionId() << 40, -1, None
    first_h, last_h, head, tail = None, None, {}, {}  # the contents with this task's first and last hash, and their names

    def border(found: dict) -> pa.RecordBatch:
        nulls = pa.nulls(len(found), pa.int64())
        return pa.record_batch([nulls, nulls, nulls, pa.array(found.values(), pa.int64()), pa.array(found.keys(), pa.string())], names=["doc", "pos", "blocks", "name", "border"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h, k = batch.column("h"), batch.column("k")
        changed = pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False)
        ranks = np.concatenate([[0], changed.cumsum()]) + rank + (last != k[0].as_py())
        names = pa.array(base + ranks, pa.int64())
        yield pa.record_batch([*(batch.column(c) for c in ("doc", "pos", "blocks")), names, pa.nulls(n, pa.string())], names=["doc", "pos", "blocks", "name", "border"])
        rank, last = int(ranks[-1]), k[n - 1].as_py()

        def of(hash_value: int, h=h, k=k, names=names) -> dict:
            same = pc.equal(h, hash_value)
            return dict(zip(k.filter(same).to_pylist(), names.filter(same).to_pylist(), strict=True))

        first_h = h[0].as_py() if first_h is None else first_h
        if h[0].as_py() == first_h:
            head |= of(first_h)
        if h[n - 1].as_py() != last_h:
            last_h, tail = h[n - 1].as_py(), {}
        if last_h != first_h:
            tail |= of(last_h)
    if first_h is not None:
        yield border(head | tail)


def _named(rows: DataFrame, level: str) -> DataFrame:
    """(doc, pos, blocks, name) of rows (doc, pos, blocks, k): equal k, equal name."""
    spark = rows.sparkSession
    dealt = rows.withColumn("h", F.xxhash64("k")).select("h", "k", "doc", "pos", "blocks").repartitionByRange(partitions(spark), "h", "doc", "pos").sortWithinPartitions("h", "k", "doc", "pos")
    out = WorkTable(dealt.mapInArrow(tidy(_name), _NAMED), f"names-{level}").read()
    # a few rows a task: the first and last content of each
    same = out.where("border IS NOT NULL").groupBy("border").agg(F.min("name").alias("to"), F.collect_set("name").alias("names")).where("size(names) > 1")
    renamed = same.select(F.explode("names").alias("name"), "to").where("name <> to")
    named = out.where("border IS NULL").drop("border")
    return named.join(F.broadcast(renamed), "name", "left").select("doc", "pos", "blocks", F.coalesce("to", "name").alias("name"))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 4096) -> DataFrame:
    """doc, blocks and name: two documents have the same blocks and name if and only if their normalised texts are equal."""
    spark = docs.sparkSession
    short_batches(spark)
    text = documents_of(docs, id_col, text_col).select("doc", normalized("text").alias("text"))
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    cut = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(cut)
    blocks = text.select("doc", cut.alias("cut")).select("doc", F.size("cut").cast("long").alias("blocks"), F.posexplode("cut").alias("pos", "k")).withColumn("pos", F.col("pos").cast("long"))
    names, done, most, level = _named(blocks, "0"), [], None, 0
    while True:
        # after `level` pairings a document has ceil(blocks / 2^level) names left; those of one number pair alike
        left = F.expr(f"(blocks + {(1 << level) - 1}) >> {level}")
        done.append(names.where(left == 1).select("doc", "blocks", "name"))
        most = (names.agg(F.max("blocks")).first()[0] or 1) if most is None else most
        if most <= 1 << level:
            return reduce(DataFrame.unionByName, done)
        even = F.col("pos") % 2 == 0
        pairs = names.where(left > 1).groupBy("doc", "blocks", F.expr("pos >> 1").alias("at")).agg(F.max(F.when(even, F.col("name"))).alias("l"), F.max(F.when(~even, F.col("name"))).alias("r"))
        pairs = pairs.select("doc", F.col("at").alias("pos"), "blocks", F.concat_ws(":", "l", F.coalesce("r", F.lit(-1))).alias("k"))
        level += 1
        names = _named(materialize(pairs, f"pairs-{level}"), str(level))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 4096) -> DataFrame:
    """One row a document: its id, keep_id (the smallest id with an equal text), group_size and kept.

    Null texts count as empty; empty texts equal each other. Rows without an id get no row and rows that repeat one
    count as one document (see `documents_of`). An empty table gives an empty result. Other columns play no part.
    """
    ids = materialize(identities(docs, id_col, text_col, block_chars), "identities")
    groups = materialize(ids.groupBy("blocks", "name").agg(F.min("doc").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    found = ids.join(groups, ["blocks", "name"])
    return found.select(F.col("doc").alias(id_col), "keep_id", "group_size", (F.col("doc") == F.col("keep_id")).alias("kept"))


def text_sha256(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The SHA-256 of each document's normalised text."""
    return documents_of(docs, id_col, text_col).select(F.col("doc").alias(id_col), F.sha2(normalized("text"), 256).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows without an id go."""
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("__kept"))
    return docs.join(kept, docs[id_col] == kept["__kept"], "left_semi")
