"""Successive data batches ("cycles") extending a base model.

Batch form
----------
``cycle_models`` builds every cycle's model in one job from count tables: the base table (all rows of
cycle 0) and one delta per later cycle (its train split). A model is the sum of the tables that feed it:

* ``star``: model k = base + delta k (every cycle starts from the same base);
* ``chain``: model k = base + delta 1 + ... + delta k (cycle k starts from cycle k-1).

Each count row is fanned out to the models it feeds (at most ``cycles`` copies of a *count* row, never of
raw text) and summed per ``(model, token)``. ``cycle_eval`` scores each cycle's test rows with the
previous model (``before``) and its own (``after``) in one keyed predict.

Streaming form
--------------
``stream_counts``: new labelled batch files arrive in a folder; ``readStream`` with ``trigger(availableNow=True)``
reads them in micro-batches of a number of bytes (or files), and ``foreachBatch`` writes that batch's count delta into the ``cycle=<k>`` partitions of a Parquet table with
dynamic partition overwrite, so replaying a batch rewrites the same partitions (idempotent).
``test_then_train``: every micro-batch is one version of the model. Its held-out rows are scored with the stored version before it and,
once its training rows' counts are added, with its own; both confusions are stored beside the counts under the
batch's number, so a replayed batch rewrites its own version and nothing else.
``stream_confusion``: a streaming ``groupBy(phase, y_true, y_pred).count()`` over scored batches in
complete mode, its state in the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.answers import CLASSES, encode_binary, parse_answer
from ..operators import naive_bayes as NB
from ..operators.splits import fraction_split_approx, stratified_split
from ..session import cut_lineage, maybe_broadcast, path_exists


def cycle_models(sources: DataFrame, n_cycles: int, mode: str = "star", classes=CLASSES) -> DataFrame:
    """``(model, token, n_<class>...)`` for models ``0..n_cycles-1`` (model 0 = base).

    ``sources``: training rows ``(src, label, text)`` -- ``src = 0`` for the base rows, ``src = k`` for the
    training rows of cycle ``k`` >= 1. Each source is counted once; its count rows are fanned out to the
    models it feeds and summed."""
    counts = NB.keyed_token_counts(sources, "src", classes)
    last = F.lit(n_cycles - 1)
    if mode == "star":
        feeds = F.when(F.col("src") == 0, F.sequence(F.lit(0), last)).otherwise(F.array(F.col("src")))
    elif mode == "chain":
        feeds = F.sequence(F.col("src"), last)
    else:
        raise ValueError(f"unknown cycle mode {mode!r}")
    return counts.withColumn("model", F.explode(feeds)).groupBy("model", "token").agg(
        *[F.sum(f"n_{c}").cast("long").alias(f"n_{c}") for c in classes])


def cycle_eval(keys: DataFrame, texts: DataFrame, n_cycles: int, train_size: int, test_size: int, mode: str = "star",
               classes=CLASSES) -> DataFrame:
    """Per-cycle predictions before and after the update: ``(cycle, phase, row_id, label, pred)``.

    ``keys``: ``(row_id, label, cycle)``; cycle 0 is the base (all its rows train it); each later cycle is split
    ``train_size`` / ``test_size`` per class. ``texts``: ``(row_id, text)``; only rows that a model is trained or tested on get
    their text."""
    assign = stratified_split(keys.where(F.col("cycle") > 0).select("cycle", "row_id", "label"), train_size, test_size,
                              group_cols=["cycle"])
    # the assignment holds at most cycles x classes x (train + test) rows
    bound = n_cycles * len(classes) * (train_size + test_size)
    split = maybe_broadcast(assign.select("cycle", "row_id", "split"), bound)
    used = (keys.join(split, ["cycle", "row_id"], "left")
            .where((F.col("cycle") == 0) | F.col("split").isNotNull()))
    # the count tables feed both the model parameters and the scoring join, so they are written once to the
    # shared checkpoint folder
    sources = (used.where((F.col("cycle") == 0) | (F.col("split") == "train")).join(texts, "row_id")
               .select(F.col("cycle").alias("src"), "label", "text"))
    models = cut_lineage(cycle_models(sources, n_cycles, mode, classes), "cycle-counts")
    params = NB.keyed_params(models, "model", classes)
    test = maybe_broadcast(assign.where(F.col("split") == "test").select("cycle", "row_id", "label"), bound).join(texts, "row_id")
    prev = F.lit(0) if mode == "star" else F.col("cycle") - 1
    runs = F.array(F.struct(F.lit("before").alias("phase"), prev.alias("model")),
                   F.struct(F.lit("after").alias("phase"), F.col("cycle").alias("model")))
    scored_in = test.withColumn("_r", F.explode(runs)).select("cycle", "row_id", "label", "text", "_r.phase",
                                                               "_r.model")
    preds = NB.keyed_predict(models, params, scored_in, "model", classes=classes, params_rows=n_cycles,
                             carry=("cycle", "phase", "label"))
    return preds.select("cycle", "phase", "row_id", "label", "pred")


def write_batches(df: DataFrame, folder: str, cycle_col: str = "cycle") -> None:
    """The rows as Parquet files grouped by cycle: every task writes its own file of each cycle it has, so no cycle
    passes through one task. The cycle stays a data column; the folder name only groups the files."""
    df.withColumn("_batch", F.col(cycle_col)).write.mode("overwrite").partitionBy("_batch").parquet(folder)


def _feed(spark: SparkSession, source: str, schema, bytes_per_trigger: int | None, files_per_trigger: int | None):
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    elif bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.parquet(source)


def stream_counts(spark: SparkSession, source: str, schema, sink: str, checkpoint: str,
                  classes=CLASSES, files_per_trigger: int | None = None, bytes_per_trigger: int | None = 1 << 30) -> DataFrame:
    """Run the count-update stream to completion and return the summed counts per cycle.

    Each micro-batch writes its count delta into the ``cycle=<k>/batch=<id>`` partitions of ``sink`` with
    dynamic partition overwrite: a replayed batch (same id, same files after a failure) rewrites exactly
    its own partitions, and batches carrying rows of the same cycle never overwrite each other. The model
    of a cycle is the sum of its batch deltas. Without any batch the result is empty."""
    stream = _feed(spark, source, schema, bytes_per_trigger, files_per_trigger)

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        delta = NB.keyed_token_counts(batch, "cycle", classes).withColumn("batch", F.lit(batch_id))
        (delta.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("cycle", "batch").parquet(sink))

    q = (stream.writeStream.foreachBatch(apply_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if not path_exists(spark, sink):
        return spark.createDataFrame([], ", ".join(["cycle int", "token string", *(f"n_{c} long" for c in classes)]))
    return NB.merge_counts(spark.read.parquet(sink), classes=classes, key="cycle")


def test_then_train(spark: SparkSession, source: str, schema, store: str, checkpoint: str, classes=CLASSES) -> DataFrame:
    """Feeds the new files of ``source`` (``row_id, label, text``) as one micro-batch, and returns the confusions of all
    versions so far: ``(version, phase, y_true, y_pred, n)``.

    A row is held out or trained on by the hash of its id (``fraction_split_approx``), so a batch needs no count. The first version has no
    model before it and so no ``before`` rows. State is the stored delta of each version: a model is the sum of the deltas up to it, read
    with partition pruning. A batch without rows adds an empty version."""
    deltas, scored = f"{store}/deltas", f"{store}/confusions"
    stream = _feed(spark, source, schema, None, None)
    cols = ["token", *(f"n_{c}" for c in classes)]
    stored_schema = "token string, " + ", ".join(f"n_{c} long" for c in classes) + ", version int"

    def apply_batch(batch: DataFrame, version: int) -> None:
        session = batch.sparkSession
        rows = fraction_split_approx(batch.where(F.col("label").isin(*classes)))
        delta = NB.token_counts(rows.where(F.col("split") == "train"), classes).withColumn("version", F.lit(version))
        (delta.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(deltas))
        known = session.read.schema(stored_schema).parquet(deltas).where(F.col("version") <= version)
        # the counts before this version feed both models, its own the second one
        feeds = F.when(F.col("version") < version, F.array(F.lit("before"), F.lit("after"))).otherwise(F.array(F.lit("after")))
        fed = known.withColumn("phase", F.explode(feeds)).groupBy("phase", "token").agg(*(F.sum(c).alias(c) for c in cols[1:]))
        models = cut_lineage(fed, "version-counts")
        params = NB.keyed_params(models, "phase", classes)
        test = (rows.where(F.col("split") != "train").select("row_id", "label", "text")
                .withColumn("phase", F.explode(F.array(F.lit("before"), F.lit("after")))))
        preds = NB.keyed_predict(models, params, test, "phase", classes=classes, params_rows=2, carry=("label",))
        conf = (preds.groupBy("phase", encode_binary(F.col("label")).alias("y_true"), encode_binary(F.col("pred")).alias("y_pred"))
                .agg(F.count(F.lit(1)).alias("n")).withColumn("version", F.lit(version)))
        conf.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(scored)

    q = (stream.writeStream.foreachBatch(apply_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    fields = "phase string, y_true int, y_pred int, n long, version int"
    if not path_exists(spark, scored):
        return spark.createDataFrame([], fields).select("version", "phase", "y_true", "y_pred", "n")
    return spark.read.schema(fields).parquet(scored).select("version", "phase", "y_true", "y_pred", "n")


def stream_confusion(spark: SparkSession, source: str, schema, sink: str, checkpoint: str,
                     state_partitions: int = 1, files_per_trigger: int | None = None,
                     bytes_per_trigger: int | None = 1 << 30) -> DataFrame:
    """Running confusion counts over scored batches (``phase, label, raw``), parsed natively.

    The state has at most phases x 2 x 2 keys, so it is kept in ``state_partitions`` partitions (fixed in
    the checkpoint at the first start): each micro-batch combines its rows map-side in parallel and only
    those partial counts are shuffled, so one state partition is enough at any input size and avoids a
    state-store commit per empty partition. The stream runs in a sibling session (same cluster, own SQL
    settings), so the caller's settings are untouched."""
    stream_session = spark.newSession()
    stream_session.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    stream = _feed(stream_session, source, schema, bytes_per_trigger, files_per_trigger)
    counts = (stream.select("phase", encode_binary(F.col("label")).alias("y_true"),
                            encode_binary(parse_answer(F.col("raw"))).alias("y_pred"))
              .groupBy("phase", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n")))

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(sink)

    q = (counts.writeStream.outputMode("complete").foreachBatch(publish)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if not path_exists(spark, sink):     # no batch came
        return spark.createDataFrame([], "phase string, y_true int, y_pred int, n long")
    return spark.read.parquet(sink)
