"""The labelled-dataset job: class-balanced train / test / eval sets with prompts.

Everything up to the prompts runs on ``(row_id, label)`` only. The selected rows are few (bounded by the
split sizes), so ``text`` is joined on last with the key set broadcast: document text is scanned once and
never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.answers import CLASSES
from ..functions.prompts import test_prompt, train_prompt
from ..operators.splits import (bootstrap_sample, eval_pool, fraction_split, fraction_split_approx, shuffle_positions,
                                 stratified_split)
from ..session import maybe_broadcast
from ..sources.tables import attach_text, labeled, labeled_keys, multi_task, read_table


@dataclass(frozen=True)
class Sizes:
    train: int
    test: int
    eval: int

    @property
    def split_rows(self) -> int:
        return (self.train + self.test) * len(CLASSES)


def assignment(spark: SparkSession, sf_dir: str, sizes: Sizes, task: str = "quality") -> DataFrame:
    """``(row_id, label, split, rank)`` for the train and test rows."""
    return stratified_split(labeled_keys(spark, sf_dir, task), sizes.train, sizes.test)


def _test_keys(assign: DataFrame, sizes: Sizes) -> DataFrame:
    cls_idx = F.when(F.col("label") == F.lit(CLASSES[0]), F.lit(0)).otherwise(F.lit(1))
    return (assign.where(F.col("split") == "test")
            .select("row_id", "label", "rank",
                    (cls_idx * sizes.test + F.col("rank") - sizes.train - 1).cast("long").alias("ord")))


def _train_keys(assign: DataFrame, sizes: Sizes) -> DataFrame:
    return shuffle_positions(assign.where(F.col("split") == "train").select("row_id", "label"),
                             rows=sizes.train * len(CLASSES))


def _eval_keys(spark: SparkSession, sf_dir: str, sizes: Sizes, policy: str, assign: DataFrame) -> tuple[DataFrame, int]:
    """The draws, and a bound of their number."""
    pool = eval_pool(labeled_keys(spark, sf_dir), assign, policy=policy, bound_rows=sizes.split_rows)
    # strict pools hold only the class domain; the labels of a reference pool (any label) are counted
    n_labels = len(CLASSES) if policy == "strict" else pool.agg(F.countDistinct("label").alias("n")).collect()[0]["n"]
    draws = bootstrap_sample(pool, sizes.eval, with_label_rank=True, max_labels=n_labels)
    ordered = draws.withColumn("ord", ((F.col("label_rank") - 1) * sizes.eval + F.col("draw") - 1).cast("long"))
    return ordered, sizes.eval * n_labels


def test_set(spark: SparkSession, sf_dir: str, sizes: Sizes, assign: DataFrame | None = None) -> DataFrame:
    """Test rows with inference prompts; ``ord`` = reference order (positive block first, then negative)."""
    assign = assign if assign is not None else assignment(spark, sf_dir, sizes)
    return (attach_text(spark, sf_dir, _test_keys(assign, sizes), bound_rows=sizes.split_rows)
            .select("row_id", "label", "rank", "ord", test_prompt(F.col("text")).alias("prompt")))


def train_set(spark: SparkSession, sf_dir: str, sizes: Sizes, assign: DataFrame | None = None) -> DataFrame:
    """Train rows with training prompts; ``ord`` = place in the seeded shuffle."""
    assign = assign if assign is not None else assignment(spark, sf_dir, sizes)
    return (attach_text(spark, sf_dir, _train_keys(assign, sizes), bound_rows=sizes.split_rows)
            .select("row_id", "label", "ord", train_prompt(F.col("text"), F.col("label")).alias("prompt")))


def eval_set(spark: SparkSession, sf_dir: str, sizes: Sizes, policy: str = "strict",
             assign: DataFrame | None = None) -> DataFrame:
    """Eval rows: ``sizes.eval`` draws with replacement per label of the pool, training prompts (the label
    is shown, as in the original eval set). ``ord`` = label groups in label order, then draw order."""
    assign = assign if assign is not None else assignment(spark, sf_dir, sizes)
    keys, bound = _eval_keys(spark, sf_dir, sizes, policy, assign)
    return (attach_text(spark, sf_dir, keys, bound_rows=bound)
            .select("row_id", "label", "draw", "ord", train_prompt(F.col("text"), F.col("label")).alias("prompt")))


def bundle_keys(spark: SparkSession, sf_dir: str, sizes: Sizes, policy: str = "strict") -> tuple[DataFrame, int]:
    """``(split, row_id, label, ord)`` of all three sets, and a bound of their number."""
    assign = assignment(spark, sf_dir, sizes)
    drawn, bound = _eval_keys(spark, sf_dir, sizes, policy, assign)
    cols = ["split", "row_id", "label", "ord"]
    keys = (_train_keys(assign, sizes).withColumn("split", F.lit("train")).select(*cols)
            .unionByName(_test_keys(assign, sizes).withColumn("split", F.lit("test")).select(*cols))
            .unionByName(drawn.withColumn("split", F.lit("eval")).select(*cols)))
    return keys, sizes.split_rows + bound


def bundle(spark: SparkSession, sf_dir: str, sizes: Sizes, policy: str = "strict") -> DataFrame:
    """All three sets in one frame with a ``split`` column (the sink writes ``partitionBy('split')``); the text is read
    once for all of them."""
    keys, bound = bundle_keys(spark, sf_dir, sizes, policy)
    prompt = (F.when(F.col("split") == "test", test_prompt(F.col("text")))
              .otherwise(train_prompt(F.col("text"), F.col("label"))))
    return attach_text(spark, sf_dir, keys, bound_rows=bound).select("split", "row_id", "label", "ord", prompt.alias("prompt"))


def full_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled row as a training prompt, in seeded shuffle order ``ord`` (no split)."""
    # the counted key set sizes the index buckets and, when small enough, is broadcast so the documents
    # stream through the text join without a shuffle
    keys = labeled_keys(spark, sf_dir)
    n = keys.count()
    return (attach_text(spark, sf_dir, shuffle_positions(keys, rows=n), bound_rows=n)
            .select("row_id", "label", "ord", train_prompt(F.col("text"), F.col("label")).alias("prompt")))


def fraction_set(spark: SparkSession, sf_dir: str, train_size: float = 0.8, eval_size: float = 0.1,
                 test_size: float = 0.1) -> DataFrame:
    """Unstratified fractional split of every labelled row; train rows get the training prompt, eval and
    test rows the inference prompt (the label is hidden from eval here)."""
    keys, n = counted_keys(spark, sf_dir)
    keys = fraction_split(keys, train_size, eval_size, test_size, n=n)
    prompt = (F.when(F.col("split") == "train", train_prompt(F.col("text"), F.col("label")))
              .otherwise(test_prompt(F.col("text"))))
    return (attach_text(spark, sf_dir, keys, bound_rows=n)
            .select("row_id", "label", "pos", "split", prompt.alias("prompt")))


def fraction_set_approx(spark: SparkSession, sf_dir: str, train_size: float = 0.8, eval_size: float = 0.1,
                        test_size: float = 0.1) -> DataFrame:
    """The fractional split by a hash threshold, prompts as in ``fraction_set``: the split adds no exchange to the scan of the
    labelled rows."""
    rows = fraction_split_approx(labeled(spark, sf_dir, columns=("text",)), train_size, eval_size, test_size)
    prompt = (F.when(F.col("split") == "train", train_prompt(F.col("text"), F.col("label")))
              .otherwise(test_prompt(F.col("text"))))
    return rows.select("row_id", "label", "split", prompt.alias("prompt"))


def counted_keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The labelled keys and their row count (one small job): the count sizes splits and indexes, and proves
    the bound under which joins broadcast the key side."""
    keys = labeled_keys(spark, sf_dir)
    return keys, keys.count()


def leak_audit(split_rows: DataFrame, spark: SparkSession, sf_dir: str, bound_rows: int | None = None) -> DataFrame:
    """Texts that occur in more than one split: ``(text_md5, n_splits, n_rows, splits)``.

    The hash is taken in the documents scan, so the join and the grouping move 32-character digests,
    never whole texts; the grouping combines map-side, so a text copied many times is one partial row per
    task and split before the shuffle."""
    digests = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"),
                                                            F.md5(F.col("text")).alias("text_md5"))
    with_md5 = digests.join(maybe_broadcast(split_rows.select("row_id", "split"), bound_rows), "row_id")
    return (with_md5.groupBy("text_md5")
            .agg(F.countDistinct("split").alias("n_splits"), F.count(F.lit(1)).alias("n_rows"),
                 F.concat_ws(",", F.array_sort(F.collect_set("split"))).alias("splits"))
            .where(F.col("n_splits") > 1))


def grid_assignment(spark: SparkSession, sf_dir: str, sizes: Sizes) -> DataFrame:
    """``(dataset, row_id, label, split, rank)`` of the train and test rows of every dataset of the task grid, split in one
    job (the window is partitioned by dataset and class)."""
    return stratified_split(multi_task(spark, sf_dir), sizes.train, sizes.test, group_cols=["dataset"])
