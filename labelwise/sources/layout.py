"""Laid-out tables: ``documents`` and ``labels`` bucketed by ``doc_id``, so that joins on it move no text.

``lay_out`` shuffles every table once, at ingest, and writes it as a bucketed table (sorted in its buckets) under the
shared folder. While a folder's tables are laid out, ``read_table`` returns them, and every plan of the library that joins text by its id
reads the text bucket by bucket: two laid-out tables join without any exchange, and a key set (splits, positions,
draws) is the only side that is shuffled. Queries that need no join read them like plain Parquet.

The number of buckets should be that of the shuffle partitions (Spark keeps the bucketed side of a join where it has no fewer), and a
multiple of the slots. A table is laid out as it is: repeated and null ids stay.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_folder

KEYS = {"documents": "doc_id", "labels": "doc_id"}
_laid_out: dict[tuple[str, str], dict[str, str]] = {}      # (application, folder) -> table names


def _place(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    return spark.sparkContext.applicationId, sf_dir.rstrip("/")


def registered(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    """The laid-out table, if this application has one."""
    tables = _laid_out.get(_place(spark, sf_dir))
    return spark.table(tables[name]) if tables and name in tables else None


def write_bucketed(df: DataFrame, key: str, name: str, buckets: int, folder: str) -> None:
    """``df`` as the table ``name``, bucketed and sorted by ``key``: one shuffle, one file per bucket."""
    (df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", folder).saveAsTable(name))


@contextlib.contextmanager
def laid_out(spark: SparkSession, sf_dir: str, buckets: int | None = None):
    """Lays out the tables of a folder, and has them read while the block runs. The stored files belong to the
    application's scratch folders; the names leave the catalog with ``forget``."""
    lay_out(spark, sf_dir, buckets)
    try:
        yield
    finally:
        _laid_out.pop(_place(spark, sf_dir), None)


def lay_out(spark: SparkSession, sf_dir: str, buckets: int | None = None) -> dict[str, str]:
    """Writes the bucketed tables of a folder and has ``read_table`` return them from now on; their names."""
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    tables = {}
    for name, key in KEYS.items():
        table = f"labelwise_{name}_{uuid.uuid4().hex}"
        write_bucketed(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"), key, table, n, scratch_folder(spark, f"bucketed-{name}"))
        tables[name] = table
    _laid_out[_place(spark, sf_dir)] = tables
    return tables


def forget(spark: SparkSession, sf_dir: str) -> None:
    """Plain Parquet is read again; the tables leave the catalog (their files stay until ``session.release``)."""
    for table in _laid_out.pop(_place(spark, sf_dir), {}).values():
        spark.sql(f"DROP TABLE IF EXISTS {table}")
