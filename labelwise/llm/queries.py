"""The queries of this subpackage: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (fingerprints, language, merge_dropout, mtree, near_duplicates, oracles, packing, preferences, quality,
               substring, suffixes, toxicity, turn_repair, whitening)
from .common import fold, table, texts
from .settings import KEEP_QUALITY, TOXIC, quality_model, tokenizer, toxicity_model

Query = Callable[[SparkSession, str], DataFrame]


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op2_sentencepiece_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer("piece_bpe_32k.model")
    encoded = merge_dropout.encode(table(spark, sf_dir, "documents"), model).withColumn("n_tokens", F.size("ids").cast("long"))
    return (merge_dropout.decode(encoded, model)
            .select("doc_id", "n_tokens", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (substring.dedup(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "n_removed", "kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(table(spark, sf_dir, "documents"))
    return (toxicity.score(docs, toxicity_model(spark, sf_dir, docs))
            .select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score",
                    F.when(F.col("score") >= TOXIC, 1).otherwise(0).alias("predicted")))


def op6_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2n (chosen) and 2n + 1 (rejected) are a pair."""
    return preferences.preference_turns(table(spark, sf_dir, "conversations"), F.floor(F.col("conv_id") / 2),
                                        F.col("conv_id") % 2 != 0)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(table(spark, sf_dir, "documents"))
    return (quality.score(docs, quality_model(spark, sf_dir, docs))
            .select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
                    F.when(F.col("score") >= KEEP_QUALITY, 1).otherwise(0).alias("predicted")))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (suffixes.duplicate_spans(table(spark, sf_dir, "documents"))
            .select("doc_id", "first_word", "n_words", "other_doc_id", "earlier"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))
            .select("doc_id", "class_id", "copy_id", "n_links"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turn_repair.with_digests(turn_repair.damage(turns), turns)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language.fit(docs, lambda doc_id: fold(doc_id, 4) != 2)
    return (language.predict(docs.drop("lang"), profiles)
            .select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_sentencepiece_merge_dropout": op2_sentencepiece_merge_dropout,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_preference_formatting": op6_preference_formatting,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_language_id": op12_language_id,
    "op13_embedding_whitening": op13_embedding_whitening,
}
ORACLE: dict[str, str] = {
    "op4_substring_dedup": oracles.OP4,
    "op6_preference_formatting": oracles.OP6,
    "op9_exact_top_k": oracles.OP9,
    "op10_ngram_jaccard_join": oracles.OP10,
    "op11_conversation_repair": oracles.OP11,
}
