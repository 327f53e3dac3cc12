"""Bindings of the labelled-text model to the Parquet tables.

``labeled`` joins ``documents`` to ``labels``. Operators that only need ids and labels use
``labeled_keys``; the (large) ``text`` column is attached late with ``attach_text`` once the key set has
been cut down, so document text is read but never shuffled when the key set is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.answers import NEGATIVE, POSITIVE
from ..session import BROADCAST_ROW_LIMIT, maybe_broadcast
from .layout import registered


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``<sf_dir>/<name>.parquet``; the folder is listed anew by every call. While the folder's tables
    are laid out (``sources.layout``), the bucketed table."""
    bucketed = registered(spark, sf_dir, name)
    if bucketed is not None:
        return bucketed
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _label_from(flag: Column) -> Column:
    """1 -> positive, any other flag -> negative, a missing flag stays missing."""
    return F.when(flag == 1, F.lit(POSITIVE)).when(flag.isNotNull(), F.lit(NEGATIVE))


def labeled_keys(spark: SparkSession, sf_dir: str, task: str = "quality") -> DataFrame:
    """``(row_id, label)`` of every labelled document that exists in ``documents``.

    ``task='quality'``: positive when quality = 1. ``task='toxic'``: positive when 1 - toxic = 1.
    An inner join of ``documents.doc_id`` (the only column read) with ``labels``, as the labelled table is
    defined; the document ids stream through it and the planner may broadcast the labels when they are the
    small side, so document ids are not shuffled (a semi join could only build on the documents side).
    """
    labels = read_table(spark, sf_dir, "labels")
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    flag = F.col("quality") if task == "quality" else (F.lit(1) - F.col("toxic"))
    return (docs.join(labels, "doc_id")
            .select(F.col("doc_id").alias("row_id"), _label_from(flag).alias("label")))


def labeled(spark: SparkSession, sf_dir: str, columns=("text", "lang", "source")) -> DataFrame:
    """``(row_id, label, text, lang, source)``: documents joined to their quality label.

    The labels (an id and a flag) are counted from the file footers. Within ``BROADCAST_ROW_LIMIT`` they are broadcast and the
    texts stream through the join; beyond it the join is left to the planner, and laid-out tables join without moving text.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", *columns)
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (docs.join(maybe_broadcast(labels, labels.count()), "doc_id")
            .select(F.col("doc_id").alias("row_id"), _label_from(F.col("quality")).alias("label"),
                    *columns))


def multi_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(dataset, row_id, label)`` for both label tasks in one frame: the dataset grid."""
    return (labeled_keys(spark, sf_dir, "quality").withColumn("dataset", F.lit("quality"))
            .unionByName(labeled_keys(spark, sf_dir, "toxic").withColumn("dataset", F.lit("toxic"))))


def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of ``conversations``: label-free text for batch scoring, keyed ``(conv_id, turn)``."""
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


def attach_text(spark: SparkSession, sf_dir: str, keys: DataFrame, id_col: str = "row_id",
                bound_rows: int | None = None, columns=("text",)) -> DataFrame:
    """Join document columns onto a key frame.

    When ``bound_rows`` (a size guaranteed by the caller's parameters, e.g. split sizes) is within
    ``BROADCAST_ROW_LIMIT`` the key side is broadcast and ``documents`` is streamed without a shuffle;
    otherwise the join is left to the planner (sort-merge, AQE may still demote it).
    """
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias(id_col), *columns)
    if bound_rows is not None and bound_rows <= BROADCAST_ROW_LIMIT:
        return docs.join(maybe_broadcast(keys, bound_rows), id_col)
    return keys.join(docs, id_col)
