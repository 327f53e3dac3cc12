"""Classification metrics as aggregations.

The data is read once: ``confusion`` is a map-side-combined ``groupBy(by, truth, pred).count()`` whose
output has at most ``groups x classes^2`` rows. Every other metric is derived from that small table, so
the metric step costs one partial aggregate per input partition plus a tiny shuffle.

Conventions (those of the usual classification report): the classes reported are those present in truth
or prediction; a zero denominator yields 0; macro = mean over reported classes; weighted = mean weighted
by support; a class absent from both sides has NULL F1 (no crash); empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import encode_binary


def display(df: DataFrame, digits: int = 4) -> DataFrame:
    """A view with every DOUBLE column rounded (records keep full values; reports show 4 or 5 digits)."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def confusion(df: DataFrame, truth: str = "y_true", pred: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    """``(*by, y_true, y_pred, n)``."""
    return (df.groupBy(*by, F.col(truth).alias("y_true"), F.col(pred).alias("y_pred"))
            .agg(F.count(F.lit(1)).alias("n")))


def class_stats(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, cls, tp, pp, support)`` for every class seen in truth or prediction."""
    as_truth = F.struct(F.col("y_true").cast("string").alias("cls"),
                        F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0)).alias("tp"),
                        F.lit(0).cast("long").alias("pp"), F.col("n").alias("support"))
    as_pred = F.struct(F.col("y_pred").cast("string").alias("cls"), F.lit(0).cast("long").alias("tp"),
                       F.col("n").alias("pp"), F.lit(0).cast("long").alias("support"))
    return (conf.select(*by, F.explode(F.array(as_truth, as_pred)).alias("s"))
            .groupBy(*by, F.col("s.cls").alias("cls"))
            .agg(F.sum("s.tp").alias("tp"), F.sum("s.pp").alias("pp"), F.sum("s.support").alias("support")))


def class_report(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, cls, precision, recall, f1, support)``."""
    s = class_stats(conf, by)
    return s.select(*by, "cls",
                    _ratio(F.col("tp"), F.col("pp")).alias("precision"),
                    _ratio(F.col("tp"), F.col("support")).alias("recall"),
                    _ratio(2 * F.col("tp"), F.col("pp") + F.col("support")).alias("f1"),
                    F.col("support").cast("long").alias("support"))


def summary(conf: DataFrame, by: Sequence[str] = (), per_class: Sequence[str] = ()) -> DataFrame:
    """``(*by, accuracy, f1_<c>..., f1_macro, f1_weighted)`` from a confusion table."""
    s = class_stats(conf, by).withColumn("_f1", _ratio(2 * F.col("tp"), F.col("pp") + F.col("support")))
    aggs = [_ratio(F.sum("tp"), F.sum("support")).alias("accuracy")]
    aggs += [F.max(F.when(F.col("cls") == F.lit(str(c)), F.col("_f1"))).alias(f"f1_{c}") for c in per_class]
    aggs += [F.avg("_f1").alias("f1_macro"),
             _ratio(F.sum(F.col("_f1") * F.col("support")), F.sum("support")).alias("f1_weighted")]
    return s.groupBy(*by).agg(*aggs)


def binary_eval(df: DataFrame, truth: str = "label", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Binary evaluation record: labels encode negative->0, anything else->1 (an unparsed answer counts
    as predicted positive). ``(*by, accuracy, f1_0, f1_1, f1_macro, f1_weighted)``."""
    enc = df.select(*by, encode_binary(F.col(truth)).alias("y_true"), encode_binary(F.col(pred)).alias("y_pred"))
    return summary(confusion(enc, by=by), by, per_class=(0, 1))


METRIC_KEYS = ("eval_accuracy", "f1_score_0", "f1_score_1", "f1_score_macro", "f1_score_weighted")
_WIDE = ("accuracy", "f1_0", "f1_1", "f1_macro", "f1_weighted")


def metrics_long(wide: DataFrame, phase_col: str = "phase", by: Sequence[str] = ()) -> DataFrame:
    """One row per metric, keyed ``<phase>_eval_accuracy``, ``<phase>_f1_score_0`` ... (the log keys)."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(w).alias("v")) for k, w in zip(METRIC_KEYS, _WIDE)])
    return (wide.select(*by, phase_col, F.explode(pairs).alias("m"))
            .select(*by, phase_col, F.concat(F.col(phase_col), F.lit("_"), F.col("m.k")).alias("metric"),
                    F.col("m.v").alias("value")))


def scalars(wide: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Named scalars ``eval/accuracy`` and ``eval/f1`` (f1 = macro F1), one row each."""
    pairs = F.array(F.struct(F.lit("eval/accuracy").alias("tag"), F.col("accuracy").alias("value")),
                    F.struct(F.lit("eval/f1").alias("tag"), F.col("f1_macro").alias("value")))
    return wide.select(*by, F.explode(pairs).alias("s")).select(*by, "s.tag", "s.value")


def before_after(wide: DataFrame, by: Sequence[str] = (), phase_col: str = "phase") -> DataFrame:
    """``(*by, metric, before, after, delta)``: both phases side by side."""
    longf = wide.select(*by, phase_col, F.explode(F.array(*[
        F.struct(F.lit(w).alias("metric"), F.col(w).alias("v")) for w in _WIDE])).alias("m"))
    piv = (longf.groupBy(*by, F.col("m.metric").alias("metric"))
           .pivot(phase_col, ["before", "after"]).agg(F.first("m.v")))
    return piv.withColumn("delta", F.col("after") - F.col("before"))


def seq2seq_eval(codes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support-weighted F1 over string codes ``'0'``, ``'1'``, ``'-100'``; ``'-100'`` never
    occurs in truth, so it has support 0 and adds no weight (but an invalid answer is always wrong)."""
    s = summary(confusion(codes, "y_true", "y_pred", by), by)
    return s.select(*by, "accuracy", F.col("f1_weighted").alias("f1"))
