"""A linear text classifier whose every prediction can be checked: full-batch perceptron steps in whole numbers.

* Features: the set of hashed words of a whole text, ``bucket = first 60 bits of md5(word) mod buckets`` (counts would let long
  texts decide).
* One step: every training row is scored with the weights so far; ``y`` of the rows on the wrong side (a score of zero is
  wrong for both) is summed per bucket and added to the weights. Rows of the rarer class count as often as those of the other
  (``balance``: whole factors), and the model is the sum of the weights after every step, which steadies the steps' swings.
* Whole numbers only, so the result depends on neither the partitioning nor the order, and SQL gives the same.

A step is one scan of the stored features and one aggregate of at most ``buckets`` rows (combined before the shuffle); the weights are
``buckets`` numbers, whatever the input, and are looked up by place. Rows without words score zero. A null text has no words;
rows of other labels are not learnt from. Without training rows all weights are zero. Ties (score zero) are the first class.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import CLASSES
from ..functions.text import hex_prefix_int, word_tokens
from ..session import cut_lineage

BUCKETS = 4096
STEPS = 12
HASH_DIGITS = 15      # hex digits of a word's hash: 60 bits


@dataclass
class LinearModel:
    weights: list[int]
    classes: tuple

    def score(self, features: Column) -> Column:
        return _score(features, self.weights)


def _score(features: Column, weights: Sequence[int]) -> Column:
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")      # folded to one literal
    return F.aggregate(features, F.lit(0).cast("long"), lambda acc, bucket: acc + F.get(table, bucket))


def hashed_words(docs: DataFrame, buckets: int = BUCKETS, text_col: str = "text", out: str = "features") -> DataFrame:
    """``docs`` with ``features``, the buckets of the words of a row, in place of its text: no shuffle."""
    words = F.array_distinct(F.coalesce(word_tokens(F.col(text_col)), F.array().cast("array<string>")))
    hashes = F.transform(words, lambda w: F.pmod(hex_prefix_int(F.md5(w), HASH_DIGITS), F.lit(buckets)).cast("int"))
    return docs.withColumn(out, F.array_distinct(hashes)).drop(*([text_col] if text_col != out else []))


def fit_linear(rows: DataFrame, steps: int = STEPS, buckets: int = BUCKETS, classes: Sequence[str] = CLASSES,
               label_col: str = "label") -> LinearModel:
    """The model of ``rows`` (``label``, ``features``); they are stored once and read by every step."""
    first, second = classes
    rows = cut_lineage(rows.where(F.col(label_col).isin(first, second))
                       .select(F.when(F.col(label_col) == first, F.lit(1)).otherwise(F.lit(-1)).cast("long").alias("y"), "features"), "features")
    sizes = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    factor = {y: max(1, sizes.get(-y, 0) // max(sizes.get(y, 1), 1)) for y in (1, -1)}
    weight = F.when(F.col("y") == 1, F.lit(factor[1])).otherwise(F.lit(factor[-1])) * F.col("y")
    weights, total = [0] * buckets, [0] * buckets
    for _ in range(steps):
        wrong = rows.where(F.col("y") * _score(F.col("features"), weights) <= 0)
        change = (wrong.select(weight.alias("w"), F.explode("features").alias("bucket"))
                  .groupBy("bucket").agg(F.sum("w").alias("change")).collect())     # at most ``buckets`` rows
        for r in change:
            weights[r.bucket] += r.change
        total = [a + b for a, b in zip(total, weights)]
    return LinearModel(total, (first, second))


def predict_linear(model: LinearModel, rows: DataFrame, carry: Sequence[str] = ("row_id", "label")) -> DataFrame:
    """``(*carry, pred, score)`` of every row of ``rows`` (with ``features``)."""
    scored = rows.select(*carry, model.score(F.col("features")).alias("score"))
    return scored.select(*carry, F.when(F.col("score") >= 0, model.classes[0]).otherwise(model.classes[1]).alias("pred"), "score")
