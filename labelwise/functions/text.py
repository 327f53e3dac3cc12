"""Column expressions for text cleaning shared by every operator.

All of these are built-in Spark expressions (JVM side, whole-stage codegen); nothing here is a UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------------
# Strings a pandas CSV scan reads as missing (pandas' default ``na_values``). Matching is exact and
# case-sensitive: "none" and " NA" stay text.
NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# What a missing value renders as inside an f-string prompt.
NA_RENDER = "nan"
# Characters Python's ``str.strip()`` removes (``str.isspace()``), as one regex character class that both
# Java regex and RE2 (the DuckDB oracle) accept.
PY_WHITESPACE_CLASS = (
    r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# Word tokens: maximal runs of letters and digits of the lower-cased text (as a match pattern, and as
# the separator pattern between them).
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
TOKEN_SPLIT_PATTERN = r"[^\p{L}\p{N}]+"
# -------------------------------------------------------------------------------------------------------

RSTRIP_PATTERN = PY_WHITESPACE_CLASS + r"+\z"
LSTRIP_PATTERN = r"\A" + PY_WHITESPACE_CLASS + "+"


def na_to_null(c: Column) -> Column:
    """Missing-value tokens become NULL, as a pandas CSV scan reads them."""
    return F.when(c.isin(*NA_STRINGS), F.lit(None).cast("string")).otherwise(c)


def render(c: Column) -> Column:
    """Value as an f-string shows it: NULL renders ``nan``."""
    return F.coalesce(c.cast("string"), F.lit(NA_RENDER))


def py_rstrip(c: Column) -> Column:
    return F.regexp_replace(c, RSTRIP_PATTERN, "")


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: Unicode whitespace at both ends (Spark ``trim`` only removes ASCII spaces)."""
    return F.regexp_replace(F.regexp_replace(c, RSTRIP_PATTERN, ""), LSTRIP_PATTERN, "")


def word_tokens(c: Column) -> Column:
    """array<string> of the lower-cased letter/digit runs of the whole text (NULL text -> NULL)."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), 0)


def hash_key(seed: int | str, c: Column) -> Column:
    """Reproducible random order key: md5 of ``'<seed>:<value>'`` (hex, so string order = numeric order)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def hex_prefix_int(key: Column, digits: int = 8) -> Column:
    """First ``digits`` (at most 15) hex characters of a hash key as a non-negative BIGINT."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("long")
