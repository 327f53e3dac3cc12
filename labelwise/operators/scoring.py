"""Batch scoring by a per-task predictor (the one Python step).

``score`` runs a predictor over Arrow batches with ``mapInPandas``: the predictor is built once per task
(``make_predictor()``), receives a pandas Series of one input column and returns the generated continuation for
each row. The parse of the answer is then a native expression (``parse_answer``). Batch size is
``spark.sql.execution.arrow.maxRecordsPerBatch``.

``nb_predictor`` is the predictor shipped with the library: the naive Bayes word table of a Spark-trained model in a
broadcast variable (its size is checked before it is collected). It takes the word arrays that the JVM made and sums
whole batches with numpy. ``nb_answers`` scores with it where the table fits and with the native join where it does
not; both give the same classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import word_tokens
from .naive_bayes import NBModel, predict, predictor_table


def score(df: DataFrame, make_predictor: Callable[[], Callable[[pd.Series], pd.Series]],
          prompt_col: str = "prompt", out: str = "answer") -> DataFrame:
    """Adds ``out`` (string) = predictor(prompt) for every row, partition by partition."""
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.StringType(), True)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = make_predictor()
        for pdf in batches:
            pdf[out] = predictor(pdf[prompt_col]).astype(object).values
            yield pdf

    return df.mapInPandas(run, schema)


def nb_predictor(spark: SparkSession, model: NBModel, max_rows: int | None = None):
    """Factory of a predictor that answers with the naive Bayes class of each array of words."""
    bc = spark.sparkContext.broadcast(predictor_table(model, **({"max_rows": max_rows} if max_rows else {})))
    classes = np.array(model.classes, object)
    prior = np.array([model.log_prior[c] for c in model.classes])
    denom = np.array([model.log_denom[c] for c in model.classes])

    def make():
        tokens, table = bc.value
        index = pd.Index(tokens)

        def answer(words: pd.Series) -> pd.Series:
            arrays = [w if w is not None else () for w in words]
            row = np.repeat(np.arange(len(arrays)), [len(w) for w in arrays])
            flat = np.concatenate([np.zeros(0, object), *(np.asarray(w, object) for w in arrays)])
            at = index.get_indexer(flat)
            row, at = row[at >= 0], at[at >= 0]
            n = len(arrays)
            known = np.bincount(row, minlength=n)
            sums = np.stack([np.bincount(row, weights=table[at, i], minlength=n) for i in range(len(classes))], 1)
            scores = prior + sums - known[:, None] * denom
            return pd.Series(classes[scores.argmax(1)], index=words.index)

        return answer

    return make


def nb_answers(spark: SparkSession, model: NBModel, prompts: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, prompt, answer)``: the naive Bayes class of every prompt."""
    if model.broadcastable():
        words = prompts.select(*keys, "prompt", word_tokens(F.col("prompt")).alias("_words"))
        return score(words, nb_predictor(spark, model), "_words").drop("_words")
    keyed = prompts.select(*keys, "prompt", F.struct(*keys).cast("string").alias("row_id"))
    return (predict(model, keyed, text_col="prompt", carry=[*keys, "prompt"])
            .select(*keys, "prompt", F.col("pred").alias("answer")))
