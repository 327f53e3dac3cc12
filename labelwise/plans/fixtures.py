"""Deterministic stand-in model outputs for testing the scoring and evaluation path.

Two raw outputs per row (phases ``before`` and ``after``), computed from ``row_id`` alone:

* before: ``row_id % 7 = 0`` -> ``maybe``; else ``row_id % 3 = 0`` -> the opposite label; else the label;
* after: ``row_id % 11 = 0`` -> the opposite label; else the label;
* when ``row_id % 2 = 0`` the answer's first letter is upper-case (so case-sensitive parsing differs);
* ``raw = prompt || ' ' || answer``.

These rules only *generate* answers; every row is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import NEGATIVE, POSITIVE


def _opposite(label: Column) -> Column:
    return F.when(label == F.lit(POSITIVE), F.lit(NEGATIVE)).otherwise(F.lit(POSITIVE))


def _cased(answer: Column, row_id: Column) -> Column:
    return F.when(row_id % 2 == 0, F.concat(F.upper(F.substring(answer, 1, 1)), F.substring(answer, 2, 1 << 30))
                  ).otherwise(answer)


def fixture_answers(df: DataFrame, id_col: str = "row_id", label_col: str = "label") -> DataFrame:
    """Adds ``phase`` and ``answer`` (two rows per input row; a narrow explode, no shuffle)."""
    rid, lab = F.col(id_col), F.col(label_col)
    before = (F.when(rid % 7 == 0, F.lit("maybe")).when(rid % 3 == 0, _opposite(lab)).otherwise(lab))
    after = F.when(rid % 11 == 0, _opposite(lab)).otherwise(lab)
    runs = F.array(F.struct(F.lit("before").alias("phase"), _cased(before, rid).alias("answer")),
                   F.struct(F.lit("after").alias("phase"), _cased(after, rid).alias("answer")))
    return df.withColumn("_run", F.explode(runs)).select("*", "_run.phase", "_run.answer").drop("_run")


def fixture_raw(df: DataFrame, prompt_col: str = "prompt", **kw) -> DataFrame:
    """``fixture_answers`` plus ``raw = prompt || ' ' || answer``."""
    return fixture_answers(df, **kw).withColumn("raw", F.concat(F.col(prompt_col), F.lit(" "), F.col("answer")))
