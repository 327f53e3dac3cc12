"""Ad hoc scoring of literal sentences through the same path as batch scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.answers import parse_answer
from ..functions.prompts import test_prompt
from ..functions.text import word_tokens
from ..operators.scoring import score
from ..sources.csv import sentence_frame


def predict_sentences(spark: SparkSession, sentences, make_predictor) -> DataFrame:
    """``(idx, text, prompt, answer, pred)`` for each literal sentence: inference prompt, predictor,
    native parse."""
    prompts = (sentence_frame(spark, sentences).select("idx", "text", test_prompt(F.col("text")).alias("prompt"))
               .withColumn("_words", word_tokens(F.col("prompt"))))
    scored = score(prompts, make_predictor, "_words").drop("_words")
    return scored.withColumn("pred", parse_answer(F.concat(F.col("prompt"), F.lit(" "), F.col("answer"))))


def predict_first(spark: SparkSession, sentences, make_predictor):
    """The class of the first sentence only, or None for no input (the single-sentence tool's contract)."""
    if not sentences:
        return None
    row = predict_sentences(spark, sentences[:1], make_predictor).select("pred").limit(1).collect()
    return row[0]["pred"] if row else None
