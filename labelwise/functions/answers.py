"""Answer parsing and label encodings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import py_strip

# --- fixed values -------------------------------------------------------------------------------------
POSITIVE, NEGATIVE, UNPARSED = "positive", "negative", "none"
CLASSES = (POSITIVE, NEGATIVE)  # order matters: the first class wins when an answer names both
SEQ2SEQ_INVALID = "-100"
# -------------------------------------------------------------------------------------------------------


def parse_answer(raw: Column, case_sensitive: bool = False) -> Column:
    """Class named after the last '=' of the generated text: 'positive', else 'negative', else 'none'.

    ``substring_index(raw, '=', -1)`` is the last '='-separated segment (the whole string when there is no
    '='). ``case_sensitive=True`` skips lower-casing.
    """
    tail = F.substring_index(raw, "=", -1)
    if not case_sensitive:
        tail = F.lower(tail)
    return (F.when(tail.contains(POSITIVE), F.lit(POSITIVE))
            .when(tail.contains(NEGATIVE), F.lit(NEGATIVE))
            .otherwise(F.lit(UNPARSED)))


def encode_binary(c: Column) -> Column:
    """negative -> 0; positive, unparsed and NULL -> 1 (an unparsed answer counts as positive)."""
    return F.when(c == F.lit(NEGATIVE), F.lit(0)).otherwise(F.lit(1))


def first_field(df: DataFrame, col: str) -> Column:
    """The column, or the first field of a struct column: a model's output may be a tuple led by its predictions."""
    kind = df.schema[col].dataType
    return F.col(col).getField(kind.names[0]) if isinstance(kind, T.StructType) else F.col(col)


def encode_seq2seq_truth(c: Column) -> Column:
    """Stripped truth to '0'/'1'; any other label fails the job, naming the value."""
    s = py_strip(c)
    return (F.when(s == F.lit(NEGATIVE), F.lit("0"))
            .when(s == F.lit(POSITIVE), F.lit("1"))
            .otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(c, F.lit("NULL"))))
                       .cast("string")))


def encode_seq2seq_pred(c: Column) -> Column:
    """Stripped prediction to '0'/'1' on exact match; anything else is the invalid class '-100'."""
    s = py_strip(c)
    return (F.when(s == F.lit(NEGATIVE), F.lit("0"))
            .when(s == F.lit(POSITIVE), F.lit("1"))
            .otherwise(F.lit(SEQ2SEQ_INVALID)))
