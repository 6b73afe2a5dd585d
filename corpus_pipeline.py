"""A training corpus from raw documents: quality, near duplicates, benchmark passages, personal data, token ids.

STAGES lists the stages in order. Each takes (spark, docs, sf_dir), works on everything that its predecessor kept, and
returns a DataFrame; run() writes it as Parquet and gives the reread table to the next. All but the last keep the
columns of documents. Rows with null texts pass every stage: the classifier scores them as empty texts and decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import importable
from folioscope.llm import bpe, decontaminate, neardup, pii, quality
from folioscope.llm.common import columns, discard, scratch, settle, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates: five-word shingles, similarity 0.8. Repeated rows count as copies."""
    return neardup.deduplicate(docs, shingle=5, percent=80)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without benchmark passages; documents that are mostly such passages go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def private_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With surrogates for personal data; n_chars follows the new text."""
    done = pii.replace_pii(docs, pii.session_key(spark))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*columns(docs.columns)) if "n_chars" in docs.columns else done


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) and decoded."""
    e = bpe.encode_documents(docs)
    return e.select("doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality classifier", good_documents),
    ("near duplicates", distinct_documents),
    ("benchmark decontamination", clean_documents),
    ("personal data", private_documents),
    ("byte-pair encoding", encoded_documents),
]

#: The classifier's training has no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as tables:  # a stage's own tables go once its result is written
            done = settle(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
            tables.remove(done._folioscope_path)
        discard(docs)
        docs = done
    return docs
