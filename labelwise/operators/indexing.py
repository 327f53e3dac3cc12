"""Dense positions in hash-key order without a single-partition window.

A global (or per-class) ``row_number`` over a huge table runs in one task per partition key. Instead each
row goes to a bucket named by the first characters of its order key, so bucket order equals key order:

1. ``count`` per (partition keys, bucket) -- a map-side-combined aggregate, at most
   ``groups x 16**prefix_len`` rows;
2. running offsets over that small table (one window per partition key, over buckets only);
3. ``row_number`` inside (partition keys, bucket) -- many parallel tasks -- plus the bucket offset.

The result equals ``row_number() OVER (PARTITION BY p ORDER BY key, ties) - 1`` exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROW_LIMIT

BUCKET = "_bucket"
TARGET_BUCKET_ROWS = 1 << 20   # rows one task ranks per bucket, at most about this many on average
MIN_PREFIX, MAX_PREFIX = 3, 8


def prefix_for_rows(n: int | None) -> int:
    """Hex-key prefix length giving buckets of about ``TARGET_BUCKET_ROWS`` rows or fewer for ``n`` rows
    (3 when ``n`` is unknown or small: 4,096 buckets)."""
    p = MIN_PREFIX
    while n is not None and p < MAX_PREFIX and n > TARGET_BUCKET_ROWS * 16 ** p:
        p += 1
    return p


def bucket_offsets(df: DataFrame, partition_cols: Sequence[str] = ()) -> DataFrame:
    """``(partition_cols, _bucket, _bn, _start, _total)`` from a frame that already has ``_bucket``."""
    counts = df.groupBy(*partition_cols, BUCKET).agg(F.count(F.lit(1)).alias("_bn"))
    running = Window.partitionBy(*partition_cols).orderBy(BUCKET).rowsBetween(
        Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*partition_cols)
    return (counts.withColumn("_start", F.coalesce(F.sum("_bn").over(running), F.lit(0)).cast("long"))
            .withColumn("_total", F.sum("_bn").over(whole).cast("long")))


def ordinal_positions(df: DataFrame, key: Column | str, tie_cols: Sequence[str] = (),
                      partition_cols: Sequence[str] = (), bucket: Column | None = None,
                      prefix_len: int = 3, out: str = "pos", max_groups: int | None = None,
                      max_buckets: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based position in ``(key, *tie_cols)`` order within ``partition_cols``.

    ``bucket`` defaults to the first ``prefix_len`` characters of ``key`` (uniform for hex hash keys, so at
    most ``16**prefix_len`` buckets). A custom ``bucket`` must state its bound in ``max_buckets`` or the
    bound is treated as unknown. ``max_groups`` bounds the number of distinct partition-key values. With
    both bounds known the offsets table is broadcast; otherwise AQE sizes that join at run time (the
    ranked side is already partitioned on the bucket, so only the small offsets side moves).
    """
    key_col = F.col(key) if isinstance(key, str) else key
    b = bucket if bucket is not None else F.substring(key_col, 1, prefix_len)
    # a non-null bucket ('' holds NULL and empty keys, which sort first anyway): no null filter is inferred
    # from the join below, so the counting and ranking branches share one exchange of the input
    with_b = df.withColumn(BUCKET, F.coalesce(b, F.lit("")))
    offsets = bucket_offsets(with_b, partition_cols).select(*partition_cols, BUCKET, "_start")
    local = with_b.withColumn(
        "_local",
        F.row_number().over(Window.partitionBy(*partition_cols, BUCKET).orderBy(key_col, *tie_cols)))
    groups = 1 if not partition_cols else max_groups
    buckets = 16 ** prefix_len if bucket is None else max_buckets
    if groups is not None and buckets is not None and groups * buckets <= BROADCAST_ROW_LIMIT:
        offsets = F.broadcast(offsets)
    return (local.join(offsets, [*partition_cols, BUCKET])
            .withColumn(out, (F.col("_start") + F.col("_local") - 1).cast("long"))
            .drop(BUCKET, "_start", "_local"))
