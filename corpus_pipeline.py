"""From raw documents to packed training sequences: each stage works on all that the one before it kept.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame, with the
columns of ``documents`` but for the last. ``run`` writes every stage's result as Parquet in the shared folder and
reads it back, so a lost executor never costs more than its own stage.

Nulls and empty texts pass the classifiers by the score of an empty text, are no duplicates and are packed as one end id;
a null doc_id stays. Ties: of equal documents the smallest doc_id stays, of repeated rows one. Texts of any length are whole in
every stage. Columns of ``documents`` beyond doc_id and text, whatever their names, are kept up to the last stage. Empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwise.llm import near_duplicates, packing, quality, substring, toxicity
from labelwise.llm.common import free_name, stored, table
from labelwise.llm.settings import KEEP_QUALITY, TOXIC, quality_model, tokenizer, toxicity_model


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is not below the threshold."""
    score = free_name(docs, "score")
    return quality.score(docs, quality_model(spark, sf_dir, docs), score).where(F.col(score) >= KEEP_QUALITY).drop(score)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    score = free_name(docs, "score")
    return toxicity.score(docs, toxicity_model(spark, sf_dir, docs), score).where(F.col(score) < TOXIC).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_duplicates.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; passages of 50 words and more that an earlier document has are cut out."""
    return substring.clean(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None   # scores and token ids are beyond SQL; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
