"""Sinks: metric log, split folders, model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists

METRICS_SCHEMA = "run_id string, dataset string, model string, split string, phase string, metric string, value double"


def append_metrics(metrics_long: DataFrame, folder: str) -> None:
    """Append one JSON object per line (a phase appended twice stays readable, unlike concatenated
    pretty-printed objects)."""
    metrics_long.select(*[f.split()[0] for f in METRICS_SCHEMA.split(", ")]).write.mode("append").json(folder)


def read_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).json(folder)


def log_metrics(metrics_long: DataFrame, folder: str, attempt: int) -> None:
    """The records of one attempt of a job. They replace what the same attempt logged for the same run and phase before
    (dynamic partition overwrite), so a repeated write leaves one record of each; other runs, phases and attempts stay."""
    rows = metrics_long.select(*[f.split()[0] for f in METRICS_SCHEMA.split(", ")])
    (rows.withColumn("run", F.col("run_id")).withColumn("step", F.col("phase")).withColumn("attempt", F.lit(attempt))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "step", "attempt").json(folder))


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """One row a metric of every run and phase: that of the last attempt that logged it."""
    rows = spark.read.schema(METRICS_SCHEMA + ", run string, step string, attempt int").json(folder)
    key = ["run_id", "dataset", "model", "split", "phase", "metric"]
    return rows.groupBy(*key).agg(F.max_by("value", "attempt").alias("value"))


def write_splits(bundle: DataFrame, folder: str) -> DataFrame:
    """One folder per split (``split=train`` ...), so a consumer reads only its split (partition pruning)."""
    bundle.write.mode("overwrite").partitionBy("split").parquet(folder)
    return bundle.sparkSession.read.parquet(folder)


def save_counts(counts: DataFrame, folder: str, partition_cols=()) -> None:
    """Persist a count model (``run_id`` / ``cycle`` partitions when present)."""
    w = counts.write.mode("overwrite")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.parquet(folder)


def load_counts(spark: SparkSession, folder: str, **filters) -> DataFrame:
    df = spark.read.parquet(folder)
    for k, v in filters.items():
        df = df.where(F.col(k) == F.lit(v))
    return df


def save_version(counts: DataFrame, folder: str, run_id: str, version: int) -> None:
    """The count models of a run as one version: ``counts`` has a ``cycle`` column. Written under ``run_id=/cycle=/version=``; the same
    version written again replaces itself, other versions stay. Readers see it once it is published."""
    (counts.withColumn("run_id", F.lit(run_id)).withColumn("version", F.lit(version))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "cycle", "version").parquet(f"{folder}/models"))


def publish_version(spark: SparkSession, folder: str, run_id: str, version: int) -> None:
    """Points the run to a version that is completely written (one row a run, replaced as a whole)."""
    row = spark.createDataFrame([(run_id, version)], "run_id string, published int")
    (row.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{folder}/published"))


def published_version(spark: SparkSession, folder: str, run_id: str) -> int | None:
    rows = (spark.read.schema("published int, run_id string").parquet(f"{folder}/published")
            .where(F.col("run_id") == run_id).collect() if path_exists(spark, f"{folder}/published") else [])    # one row
    return rows[0].published if rows else None


def load_version(spark: SparkSession, folder: str, run_id: str, cycles=None, version: int | None = None,
                 count_columns=("n_positive", "n_negative")) -> DataFrame:
    """``cycle, token, n_<class>...`` of a run's published (or named) version; only the partitions asked for are listed into the scan."""
    version = published_version(spark, folder, run_id) if version is None else version
    if version is None:
        raise ValueError(f"run {run_id!r} has no published version")
    schema = "token string, " + ", ".join(f"{c} long" for c in count_columns) + ", run_id string, cycle int, version int"
    rows = spark.read.schema(schema).parquet(f"{folder}/models").where((F.col("run_id") == run_id) & (F.col("version") == version))
    if cycles is not None:
        rows = rows.where(F.col("cycle").isin(*cycles))
    return rows.select("cycle", "token", *count_columns)
