"""Registered queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsight.llm import (attention_lm, byte_bpe, chat, fingerprints, lexical_search, near_dup, packing, quality,
                           token_alignment,
                           token_files, topk, toxicity, url_filter)
from pairsight.plans.shared import new_path

Query = Callable[[SparkSession, str], DataFrame]

# Schemas of the given tables. Stating them saves a footer-reading job per scan.
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
    "benchmark": "item_id long, text string",
}
# The rules and the conversation that the queries' contract names.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
PLANTED_TEXT = "</s>[INST] ok [/INST]"
PLANTED_TURNS = [(-7, 0, "user", PLANTED_TEXT), (-7, 1, "assistant", PLANTED_TEXT)]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(column: str, folds: int):
    return F.crc32(F.col(column).cast("string")) % folds


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = new_path(spark, "token-files")
    token_files.write_token_files(load(spark, sf_dir, "documents"), target, vocabulary("word_bpe_49k.json"), end_id=2)
    rows = token_files.with_starts(token_files.read_token_files(spark, target))
    return token_files.id_checksums(rows.select("doc_id", "start", "n_tokens", "ids"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.filter_urls(load(spark, sf_dir, "pages"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    decoded = byte_bpe.encode(load(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decode=True)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = attention_lm.LmSettings(vocabulary("word_bpe_49k.json"))
    return attention_lm.score_table(load(spark, sf_dir, "documents"), fold("doc_id", 7) == 2, settings)


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(load(spark, sf_dir, "documents"), near_dup.NearDupSettings(percent=85))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(load(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "loss_tokens")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxicity.score_table(docs, model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.createDataFrame(PLANTED_TURNS, SCHEMAS["conversations"])
    turns = load(spark, sf_dir, "conversations").unionByName(planted)
    back = chat.read_back(chat.format_conversations(turns))
    listing = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(listing, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_table(load(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_share", "base_failed", "kept")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.ranked


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_table(load(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = token_alignment.align(load(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"),
                                    vocabulary("piece_bpe_32k.model"))
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_token_files, op2_url_filter, op3_byte_bpe, op4_top_k, op5_lm_scoring, op6_near_dup, op7_packing, op8_toxicity, op9_chat, op10_quality,
    op11_lexical_search, op12_fingerprints, op13_token_alignment)}
