"""Prompt rendering (training prompt with the label, inference prompt without it).

Both are a single ``concat`` projection, fused into the scan's codegen stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_rstrip, render

# --- fixed values -------------------------------------------------------------------------------------
# Prompt bodies, character for character (two body lines end in a space; continuation lines are indented
# by 12 spaces; the blank line is empty). The training prompt keeps a stray first line naming its
# generator; the inference prompt starts at "Analyze".
_INDENT = " " * 12
_BODY = (
    "Analyze the sentiment of the text enclosed in square brackets, \n"
    + _INDENT + "determine if it is positive, or negative, and return the answer as \n"
    + _INDENT + 'the corresponding sentiment label "positive" or "negative"\n'
    + "\n"
    + _INDENT + "["
)
TRAIN_HEAD = "generate_prompt\n" + _INDENT + _BODY
TEST_HEAD = _BODY
TRAIN_SEP = "] = "
TEST_TAIL = "] ="
# -------------------------------------------------------------------------------------------------------


def train_prompt(text: Column, label: Column, with_prefix: bool = True) -> Column:
    """``[text] = label``, then Python right-strip of the whole string.

    The string ends with the label, so the strip only reaches into it: with a non-blank label the result
    is ``... ] = <label right-stripped>``, with a blank one the strip eats the separator's space too and
    ends at ``=``. Only the (short) label is scanned, never the whole text."""
    head = TRAIN_HEAD if with_prefix else TEST_HEAD
    lab = py_rstrip(render(label))
    tail = F.when(lab == F.lit(""), F.lit(TRAIN_SEP.rstrip())).otherwise(F.concat(F.lit(TRAIN_SEP), lab))
    return F.concat(F.lit(head), render(text), tail)


def test_prompt(text: Column) -> Column:
    """``[text] =``; both ends are constants, so the reference's strip is a no-op here."""
    return F.concat(F.lit(TEST_HEAD), render(text), F.lit(TEST_TAIL))


def sql_literal(s: str) -> str:
    """A string as a SQL literal (raw newlines are legal inside quotes)."""
    return "'" + s.replace("'", "''") + "'"
