"""A training corpus from documents: language ID, exact dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns what the next one works on; all but the last return the columns of
documents. Rows without an id have no result in any stage and go. `run` writes each stage's result before the next begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import decontaminate, exact_dedup, langid, packing, simhash
from sievework.llm.base import materialize

#: SQL has no form of the language model, the fingerprints or the packing; tests/llm compare each stage with brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model tells: without letters, or with two languages as likely, they go."""
    model = langid.fit(docs)
    found = langid.identify(docs, model, margin=0.02).where("lang_pred = 'und' OR ambiguous").select(F.col("doc_id").alias("__gone"))
    return docs.where("doc_id IS NOT NULL").join(found, F.col("doc_id") == F.col("__gone"), "left_anti")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest id."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts (five-word shingles, similarity 0.8) the one with the smallest id."""
    return simhash.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without much text of the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), "word")


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", clean), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
