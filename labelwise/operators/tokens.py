"""Word tokens, a rank vocabulary and fixed-shape token arrays.

* ``explode_tokens``: ``(id, pos, token)`` for every word of the whole text (1-based ``pos``).
* ``vocabulary``: distinct tokens numbered 1.. in binary string order (0 is the pad id; ids are BIGINT). The distinct
  tokens are range-partitioned on the token (sampled bounds, so no partition is hot) and stored once; a token's id is
  its place in its range plus the sizes of the ranges before it.
* ``token_ids``: tokens joined to the vocabulary (a shuffle on token; AQE's skew handling splits hot tokens)
  and regrouped per row in token order.
* array shaping (pad, truncate, mask, unmask) is pure ``transform``/``slice`` -- no Python.

A row without words takes part in joins under a key of its own that is no word, so such rows never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_tokens
from ..session import cut_lineage, maybe_broadcast, spread

PAD_ID = 0
IGNORE_ID = -100


def explode_tokens(df: DataFrame, text_col: str = "text", id_col: str = "row_id", outer: bool = False,
                   max_pos: int | None = None) -> DataFrame:
    """``(id, pos, token)`` per word of the whole text. ``outer=True`` keeps a row without words (or with
    NULL text) as one ``(id, NULL, NULL)`` row, so per-row aggregates still see it. ``max_pos`` emits only
    the first ``max_pos`` words (the whole text is still tokenised; a truncating consumer then never
    carries the rest through its join)."""
    df = spread(df.select(id_col, text_col), id_col)
    gen = F.posexplode_outer if outer else F.posexplode
    words = word_tokens(F.col(text_col))
    if max_pos is not None:
        words = F.slice(words, 1, max_pos)
    return (df.select(id_col, gen(words).alias("pos", "token"))
            .withColumn("pos", (F.col("pos") + 1).cast("int")))


def word_key(token: Column, row: Column) -> Column:
    """The token, or for a row without words a key of its own (words hold no space)."""
    return F.coalesce(token, F.concat(F.lit(" "), row.cast("string")))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """``(token, id)``, ``id`` = 1-based rank of the token in binary order (NULL tokens, the placeholders of
    an outer explode, are not words)."""
    distinct = tokens.select("token").where(F.col("token").isNotNull()).distinct()
    ranges = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(distinct.repartitionByRange(ranges, "token").withColumn("_range", F.spark_partition_id()), "vocabulary")
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))              # one row a range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("token"))
    return (placed.withColumn("_place", inside).join(maybe_broadcast(starts, ranges), "_range")
            .select("token", (F.col("_start") + F.col("_place")).cast("long").alias("id")))


def vocabulary_of(tokens: DataFrame, wanted) -> DataFrame:
    """``(token, id)`` of a few given tokens, with the ids that ``vocabulary`` gives them among ``tokens``: the number of smaller
    distinct tokens is an aggregate, so no token is sorted, numbered or stored. A token that does not occur has no row."""
    distinct = tokens.select("token").where(F.col("token").isNotNull()).distinct()
    wanted = sorted(set(wanted))
    row = distinct.agg(*(F.count(F.when(F.col("token") <= w, True)).alias(f"_{k}") for k, w in enumerate(wanted)),
                       *(F.max(F.col("token") == w).alias(f"_has{k}") for k, w in enumerate(wanted)))
    each = F.array(*(F.struct(F.lit(w).alias("token"), F.col(f"_{k}").alias("id"), F.col(f"_has{k}").alias("has")) for k, w in enumerate(wanted)))
    return row.select(F.explode(each).alias("v")).where("v.has").select("v.token", "v.id")


def token_ids(tokens: DataFrame, vocab: DataFrame, id_col: str = "row_id", max_pos: int | None = None) -> DataFrame:
    """``(id_col, ids array<long>)`` in token order, one row per row of ``tokens``' ids: from an outer
    explode, a row without words gets ``[]`` here, so no join back to the row ids is needed. ``max_pos``
    keeps only positions a later truncation keeps (the truncation is the operator's feature; the text is
    still tokenised whole)."""
    t = tokens if max_pos is None else tokens.where(F.col("pos").isNull() | (F.col("pos") <= max_pos))
    joined = t.withColumn("token", word_key(F.col("token"), F.col(id_col))).join(vocab, "token", "left")
    pair = F.when(F.col("id").isNotNull(), F.struct("pos", "id"))
    return (joined.groupBy(id_col)
            .agg(F.array_sort(F.collect_list(pair)).alias("_p"))
            .select(id_col, F.transform("_p", lambda s: s["id"]).alias("ids")))


def pad_truncate(arr: Column, n: int | Column, pad: int = PAD_ID) -> Column:
    """Exactly ``n`` elements: cut on the right, or filled with ``pad``."""
    n_col = n if isinstance(n, Column) else F.lit(n)
    return F.slice(F.concat(arr, F.array_repeat(F.lit(pad).cast("long"), n_col)), 1, n_col)


def effective_length(requested: int, model_max: int) -> int:
    return min(requested, model_max)


def pad_to_longest(df: DataFrame, arr_col: str, batch_col: str, pad: int = PAD_ID, out: str | None = None) -> DataFrame:
    """Pad each array to the longest array of its batch (batches are small and bounded)."""
    longest = F.max(F.size(arr_col)).over(Window.partitionBy(batch_col))
    return df.withColumn(out or arr_col, pad_truncate(F.col(arr_col), longest, pad))


def mask(arr: Column, pad: int = PAD_ID) -> Column:
    return F.transform(arr, lambda x: F.when(x == pad, F.lit(IGNORE_ID)).otherwise(x))


def unmask(arr: Column, pad: int = PAD_ID) -> Column:
    return F.transform(arr, lambda x: F.when(x == IGNORE_ID, F.lit(pad)).otherwise(x))


def decode(df: DataFrame, arr_col: str, vocab: DataFrame, id_col: str = "row_id",
           specials=(PAD_ID, IGNORE_ID), out: str = "decoded") -> DataFrame:
    """Ids back to text, skipping special ids; tokens joined by a space. Rows whose array is all
    specials decode to ''."""
    # specials leave before the explode; a row without any other id joins under a negative key of its own
    plain = F.filter(F.col(arr_col), lambda x: ~x.isin(*specials))
    ex = df.select(id_col, F.posexplode_outer(plain).alias("pos", "id"))
    own = -1 - F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 2)
    ex = ex.withColumn("id", F.coalesce(F.col("id").cast("long"), own))
    pair = F.when(F.col("token").isNotNull(), F.struct("pos", "token"))
    words = (ex.join(vocab, "id", "left").groupBy(id_col)
             .agg(F.array_sort(F.collect_list(pair)).alias("_w")))
    return words.select(id_col, F.array_join(F.transform("_w", lambda s: s["token"]), " ").alias(out))


def token_count(c: Column) -> Column:
    return F.size(word_tokens(c))
