"""Production parameters shared by the queries and the pipeline: label folds, thresholds, tokenizer files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import quality, toxicity
from .common import fold, table

KEEP_QUALITY = 0.3     # scores from here on are label 1
TOXIC = 0.7


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file (the same on every executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", lambda doc_id: fold(doc_id, 3) != 1)


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality.Model:
    return quality.fit(docs, table(spark, sf_dir, "labels"), "quality", lambda doc_id: fold(doc_id, 5) != 0)
