"""Class-balanced exact-count splits, eval pools, shuffles and fractional splits.

Randomness is replaced by hash order: a row's place is ``md5('<seed>:<row_id>')`` (ties by ``row_id``),
so every result is reproducible at any partitioning and checkable in SQL.

Per-class top-k at scale
------------------------
A window partitioned by class runs in one task per class. ``stratified_split`` therefore

* counts rows per (group, class) -- also the size guard, one row per class reaches the driver;
* keeps, per class, only rows whose 32-bit key prefix is below a threshold chosen so the expected
  number of survivors is ``k + 12*sqrt(k) + 64`` (the k smallest keys are always among them, because a
  smaller prefix means a smaller key); the window then ranks only these candidates;
* fails loudly (``raise_error``) in the astronomically unlikely case that fewer than k survive, so the
  result is exact or absent, never short.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.answers import CLASSES
from ..functions.text import hash_key, hex_prefix_int
from ..session import maybe_broadcast
from .indexing import ordinal_positions, prefix_for_rows

# --- fixed values -------------------------------------------------------------------------------------
SPLIT_SEED = 42     # per-class split and fractional split
SHUFFLE_SEED = 10   # train shuffle and eval bootstrap draws
# -------------------------------------------------------------------------------------------------------

PREFILTER_MIN_ROWS = 50_000   # below this a class is ranked whole
_SENTINEL_KEY = "~"           # sorts after every lower-case hex key
_KEY_SPACE = 1 << 32
DRAW_DIGITS = 15              # hex digits of a draw: 60 bits


def _match(group_cols: Sequence[str], group: tuple, label_col: str, label) -> Column:
    cond = F.col(label_col) == F.lit(label)
    for c, v in zip(group_cols, group):
        cond = cond & (F.col(c).isNull() if v is None else (F.col(c) == F.lit(v)))
    return cond


def _expected_candidates(need: int) -> float:
    return need + 12 * math.sqrt(need) + 64


def _threshold(n: int, need: int) -> int | None:
    if n <= PREFILTER_MIN_ROWS or need * 4 >= n:
        return None
    return min(_KEY_SPACE, math.ceil(_KEY_SPACE * _expected_candidates(need) / n))


def class_counts(df: DataFrame, label_col: str, classes: Sequence[str], group_cols: Sequence[str]) -> dict:
    """``{(group..., class): n}`` for every group seen and every class (missing classes count 0)."""
    rows = (df.where(F.col(label_col).isin(*classes))
            .groupBy(*group_cols, label_col).agg(F.count(F.lit(1)).alias("n")).collect())
    out = {}
    groups = {tuple(r[c] for c in group_cols) for r in rows} or {()}
    for g in groups:
        for c in classes:
            out[(*g, c)] = 0
    for r in rows:
        out[(*(r[c] for c in group_cols), r[label_col])] = r["n"]
    return out


def stratified_split(df: DataFrame, train_size: int, test_size: int, *, seed: int = SPLIT_SEED,
                     id_col: str = "row_id", label_col: str = "label", classes: Sequence[str] = CLASSES,
                     group_cols: Sequence[str] = ()) -> DataFrame:
    """Exactly ``train_size`` + ``test_size`` rows per class (per group), disjoint.

    Returns only the selected rows: ``(*group_cols, id, label, split, rank)`` with ``rank`` 1-based in
    hash order; ranks ``1..train_size`` are train, the next ``test_size`` test. Raises ``ValueError``
    naming the class when a class is too small.
    """
    need = train_size + test_size
    counts = class_counts(df, label_col, classes, group_cols)
    for key, n in sorted(counts.items(), key=lambda kv: str(kv[0])):
        if n < need:
            where = f" in group {key[:-1]}" if group_cols else ""
            raise ValueError(f"class {key[-1]!r}{where} has {n} rows, fewer than train_size + test_size "
                             f"= {need} (short by {need - n})")
    keyed = (df.where(F.col(label_col).isin(*classes))
             .select(*group_cols, id_col, label_col, hash_key(seed, F.col(id_col)).alias("_key")))

    thresholds = {k: _threshold(n, need) for k, n in counts.items()}
    prefiltered = any(t is not None for t in thresholds.values())
    if prefiltered:
        h = hex_prefix_int(F.col("_key"))
        keep = None
        for k, t in thresholds.items():
            cond = _match(group_cols, k[:-1], label_col, k[-1])
            if t is not None:
                cond = cond & (h < F.lit(t))
            keep = cond if keep is None else (keep | cond)
        keyed = keyed.where(keep)

    part = Window.partitionBy(*group_cols, label_col)
    # rows a class would rank: its candidates when pre-filtered, else all its rows
    rank_rows = max(_expected_candidates(need) if thresholds[k] is not None else n for k, n in counts.items())
    if rank_rows > PREFILTER_MIN_ROWS:
        # many rows to rank in a class (a large class keeping most of its rows, or a large k): exact ranks
        # from the two-level index (parallel over key-prefix buckets) instead of one task sorting them all
        if prefiltered:
            got = class_counts(keyed, label_col, classes, group_cols)   # candidates: one row per class
            short = sorted(str(k) for k, t in thresholds.items() if t is not None and got.get(k, 0) < need)
            if short:
                raise ValueError(f"split candidate shortfall in {', '.join(short)}; rerun with a wider threshold")
        ranked = ordinal_positions(keyed, "_key", [id_col], partition_cols=[*group_cols, label_col],
                                   prefix_len=prefix_for_rows(int(rank_rows)), out="rank",
                                   max_groups=len(counts))
        ranked = ranked.withColumn("rank", F.col("rank") + 1)
        return (ranked.where(F.col("rank") <= need)
                .select(*group_cols, id_col, label_col,
                        F.when(F.col("rank") <= train_size, F.lit("train")).otherwise(F.lit("test")).alias("split"),
                        F.col("rank").cast("long").alias("rank")))
    if prefiltered:
        # one sentinel per pre-filtered class, ordered after every hex key: the class always has a row in
        # the window, so a shortfall (even to zero candidates) is detected instead of returning fewer rows
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in keyed.schema.fields])
        rows = [tuple(list(k[:-1]) + [None, k[-1], _SENTINEL_KEY]) for k, t in thresholds.items() if t is not None]
        keyed = keyed.unionByName(df.sparkSession.createDataFrame(rows, schema))
    ranked = keyed.withColumn("rank", F.row_number().over(part.orderBy("_key", id_col)))
    if prefiltered:
        ranked = (ranked.withColumn("_cand", F.count(F.col(id_col)).over(part))
                  .where(F.when(F.col("_cand") < need,
                                F.raise_error(F.lit("split candidate shortfall; rerun with a wider "
                                                    "threshold"))).otherwise(F.lit(True)))
                  .where(F.col(id_col).isNotNull())
                  .drop("_cand"))
    return (ranked.where(F.col("rank") <= need)
            .select(*group_cols, id_col, label_col,
                    F.when(F.col("rank") <= train_size, F.lit("train")).otherwise(F.lit("test")).alias("split"),
                    F.col("rank").cast("long").alias("rank")))


def eval_pool(df: DataFrame, assignment: DataFrame, *, policy: str = "strict", id_col: str = "row_id",
              label_col: str = "label", classes: Sequence[str] = CLASSES, group_cols: Sequence[str] = (),
              bound_rows: int | None = None) -> DataFrame:
    """Rows eligible for the eval sample.

    ``strict``: rows of the class domain used in neither train nor test (leak-free).
    ``reference``: every non-NULL-labelled row except the *last* class's train and test rows -- the
    behaviour of the original loop, whose exclusion list only kept its last iteration. Labels outside the
    class domain (a header row, a third class) stay in this pool.

    ``assignment`` is small (bounded by the split sizes, ``bound_rows``), so the anti join broadcasts it
    and streams ``df`` without a shuffle.
    """
    if policy == "reference":
        used = assignment.where(F.col(label_col) == F.lit(classes[-1]))
        base = df.where(F.col(label_col).isNotNull())
    elif policy == "strict":
        used = assignment
        base = df.where(F.col(label_col).isin(*classes))
    else:
        raise ValueError(f"unknown eval pool policy {policy!r}")
    used = maybe_broadcast(used.select(*group_cols, id_col), bound_rows)
    return base.join(used, [*group_cols, id_col], "left_anti")


def bootstrap_sample(pool: DataFrame, n: int, *, seed: int = SHUFFLE_SEED, id_col: str = "row_id",
                     label_col: str = "label", group_cols: Sequence[str] = (), prefix_len: int = 4,
                     with_label_rank: bool = False, max_labels: int | None = None) -> DataFrame:
    """``n`` draws per label **with replacement**: ``(*group_cols, label, draw, id)``, plus ``label_rank``
    (1-based place of the label in label order within its group) when ``with_label_rank``.

    Draw ``j`` of label ``L`` picks the pool row at position
    ``int(md5('<seed>:<L>:<j>')[:15], 16) mod pool_size`` in ``md5('<seed>:<id>')`` order (60 bits, so every row of
    any pool can be drawn).

    Positions use the two-level index of ``indexing``, and only the buckets some draw lands in are
    ranked, so the work is ``O(pool)`` for the scan and count plus ``O(pool * draws / buckets)`` for
    ranking -- no window over a whole class. A draw finds its bucket by an as-of lookup (bucket starts and
    draws sorted together per label, the last start carried forward), never by pairing every draw with
    every bucket. ``max_labels`` (known or counted) bounds the located draws: within the broadcast limit their
    buckets are broadcast, so the pool is filtered where it is read and only rows of hit buckets are shuffled.
    """
    parts = [*group_cols, label_col]
    keyed = (pool.where(F.col(label_col).isNotNull())
             .select(*parts, id_col, hash_key(seed, F.col(id_col)).alias("_key"))
             .withColumn("_bucket", F.substring("_key", 1, prefix_len)))
    counts = keyed.groupBy(*parts, "_bucket").agg(F.count(F.lit(1)).alias("_bn"))
    running = Window.partitionBy(*parts).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counts.withColumn("_start", F.coalesce(F.sum("_bn").over(running), F.lit(0)))
               .withColumn("_pool_n", F.sum("_bn").over(Window.partitionBy(*parts))))
    sizes = offsets.where(F.col("_start") == 0).select(*parts, "_pool_n")   # each label's first bucket: no shuffle
    # label order ranked on this one-row-per-label table, not over the draws
    sizes = sizes.withColumn("label_rank", F.row_number().over(Window.partitionBy(*group_cols).orderBy(label_col)))
    draw_key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(label_col), F.lit(":"), F.col("draw").cast("string")))
    draws = (sizes.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))))
             .withColumn("_idx", F.pmod(hex_prefix_int(draw_key, DRAW_DIGITS), F.col("_pool_n"))))
    # as-of lookup: non-empty buckets have strictly increasing starts, so a draw's bucket is the last one
    # starting at or before its index (a bucket start sorts before a draw at the same place). The window
    # holds one label's buckets and draws: at most 16**prefix_len + n rows, whatever the pool size.
    no_str, no_long = F.lit(None).cast("string"), F.lit(None).cast("long")
    no_int = F.lit(None).cast("int")
    events = (offsets.select(*parts, F.col("_start").alias("_at"), F.lit(0).alias("_kind"), "_bucket",
                             "_start", no_long.alias("draw"), no_int.alias("label_rank"))
              .unionByName(draws.select(*parts, F.col("_idx").alias("_at"), F.lit(1).alias("_kind"),
                                        no_str.alias("_bucket"), no_long.alias("_start"), "draw", "label_rank")))
    upto = Window.partitionBy(*parts).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    located = (events.withColumn("_b", F.last("_bucket", ignorenulls=True).over(upto))
               .withColumn("_s", F.last("_start", ignorenulls=True).over(upto))
               .where(F.col("_kind") == 1)
               .select(*parts, "draw", "label_rank", F.col("_b").alias("_bucket"),
                       (F.col("_at") - F.col("_s") + 1).alias("_local")))
    hit = maybe_broadcast(located.select(*parts, "_bucket").distinct(), None if max_labels is None else n * max_labels)
    ranked = (keyed.join(hit, [*parts, "_bucket"], "left_semi")
              .withColumn("_local", F.row_number().over(
                  Window.partitionBy(*parts, "_bucket").orderBy("_key", id_col)).cast("long")))
    return (located.join(ranked, [*parts, "_bucket", "_local"])
            .select(*group_cols, label_col, "draw", id_col, *(["label_rank"] if with_label_rank else [])))


def shuffle_positions(df: DataFrame, *, seed: int = SHUFFLE_SEED, id_col: str = "row_id",
                      out: str = "ord", rows: int | None = None) -> DataFrame:
    """Seeded full permutation: ``out`` = 0-based place of the row in ``md5('<seed>:<id>')`` order.

    ``rows`` (a count or bound of ``df``) sizes the index buckets. To materialise in that order,
    ``orderBy(out)`` (a range-partitioned sort)."""
    return (ordinal_positions(df.withColumn("_key", hash_key(seed, F.col(id_col))), "_key", [id_col],
                              prefix_len=prefix_for_rows(rows), out=out)
            .drop("_key"))


def fraction_sizes(n: int, train_size: float = 0.8, eval_size: float = 0.1, test_size: float = 0.1) -> dict:
    """Sizes of the two-stage fractional split: ``temp = ceil((1-train)*n)``, ``test = ceil(share*temp)``."""
    n_temp = math.ceil((1 - train_size) * n)
    n_test = math.ceil(test_size / (test_size + eval_size) * n_temp)
    return {"train": n - n_temp, "eval": n_temp - n_test, "test": n_test}


def fraction_split(df: DataFrame, train_size: float = 0.8, eval_size: float = 0.1, test_size: float = 0.1, *,
                   seed: int = SPLIT_SEED, id_col: str = "row_id", n: int | None = None) -> DataFrame:
    """Unstratified train/eval/test split with exact sizes: the first ``train`` rows in hash order are
    train, the next ``eval`` rows eval, the rest test. Adds ``split`` and ``pos``. ``n``: the row count of
    ``df`` when the caller has it (counted otherwise)."""
    n = df.count() if n is None else n
    sz = fraction_sizes(n, train_size, eval_size, test_size)
    pos = ordinal_positions(df.withColumn("_key", hash_key(seed, F.col(id_col))), "_key", [id_col],
                            prefix_len=prefix_for_rows(n), out="pos").drop("_key")
    return pos.withColumn(
        "split",
        F.when(F.col("pos") < sz["train"], F.lit("train"))
        .when(F.col("pos") < sz["train"] + sz["eval"], F.lit("eval"))
        .otherwise(F.lit("test")))


APPROX_PARTS = 1_000_000      # a row falls into one of this many parts by its hash


def fraction_bounds(train_size: float = 0.8, eval_size: float = 0.1, test_size: float = 0.1) -> tuple[int, int]:
    """The first parts that are not train and not eval, in the approximate split."""
    total = train_size + eval_size + test_size
    train = round(APPROX_PARTS * train_size / total)
    return train, train + round(APPROX_PARTS * eval_size / total)


def fraction_split_approx(df: DataFrame, train_size: float = 0.8, eval_size: float = 0.1, test_size: float = 0.1, *,
                          seed: int = SPLIT_SEED, id_col: str = "row_id") -> DataFrame:
    """Unstratified train/eval/test split by a hash threshold: adds ``split`` (a null id: hashed as empty text).

    A row's split depends on its id alone: one pass, no count, no rank and no exchange, and rows that arrive later never move
    others. Sizes are binomial (``fraction_spread``); ``fraction_split`` has exact ones."""
    train, held = fraction_bounds(train_size, eval_size, test_size)
    part = F.pmod(hex_prefix_int(hash_key(seed, F.coalesce(F.col(id_col).cast("string"), F.lit(""))), DRAW_DIGITS), F.lit(APPROX_PARTS))
    return df.withColumn("split", F.when(part < train, F.lit("train")).when(part < held, F.lit("eval")).otherwise(F.lit("test")))


def fraction_spread(split_rows: DataFrame, train_size: float = 0.8, eval_size: float = 0.1, test_size: float = 0.1) -> DataFrame:
    """``split, n, expected, deviations``: sizes of an approximate split, and how many standard deviations of the binomial
    distribution each is away from its expectation. One aggregate; a split without rows is listed too."""
    train, held = fraction_bounds(train_size, eval_size, test_size)
    shares = {"train": train, "eval": held - train, "test": APPROX_PARTS - held}
    n = {name: F.count(F.when(F.col("split") == name, True)) for name in shares}
    row = split_rows.agg(F.count(F.lit(1)).alias("_all"), *(c.alias(f"_{name}") for name, c in n.items()))
    sizes = F.explode(F.array(*(F.struct(F.lit(name).alias("split"), F.col(f"_{name}").alias("n"), F.lit(k / APPROX_PARTS).alias("_p"))
                                for name, k in shares.items()))).alias("_s")
    expected, spread = F.col("_all") * F.col("_p"), F.sqrt(F.col("_all") * F.col("_p") * (1 - F.col("_p")))
    return (row.select("_all", sizes).select("_all", "_s.*")
            .select("split", "n", expected.alias("expected"), F.when(spread > 0, (F.col("n") - expected) / spread).alias("deviations")))
