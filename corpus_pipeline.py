"""Corpus pipeline: quality rules, toxicity, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is written as
Parquet in the shared folder and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsight.llm import near_dup, packing, quality, queries, toxicity
from pairsight.plans.shared import write_once


# Pieces of text whose ids a packing worker keeps: about 170 bytes each, in every worker of an executor.
KEPT_PIECES = 400_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules."""
    return quality.keep_good(docs)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the classifier learns from the labels of what is left here."""
    model = toxicity.fit(docs, queries.load(spark, sf_dir, "labels"), queries.fold("doc_id", 5) != 0)
    return toxicity.keep_civil(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return near_dup.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row per piece, with its ids as little-endian 32-bit integers."""
    return packing.pack_documents(docs, queries.vocabulary("byte_bpe_50k.json"), kept_pieces=KEPT_PIECES)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", remove_toxic),
    ("near duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]

# The stages score, sketch and tokenise text, which SQL cannot state; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = queries.load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = write_once(docs, name.replace(" ", "-"))
    return docs.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
