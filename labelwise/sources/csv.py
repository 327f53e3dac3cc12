"""Headerless two-column labelled CSV (``label, text``), as the original files are laid out.

* quotes are doubled inside quoted fields, fields may span lines; records end at LF or CRLF; empty lines between records are none;
* a header row, if present, is data (label ``label``);
* the pandas missing-value strings become NULL (``NA_STRINGS``);
* invalid UTF-8 is replaced by U+FFFD (lenient, ``on_bad_bytes='replace'``); the strict loader either
  flags such rows for quarantine (``'quarantine'`` adds ``bad_bytes``) or fails the job (``'error'``). The raw bytes decide, so a
  U+FFFD that the file itself holds is valid text;
* a row with more than two fields is ragged: by default the job fails and names the file (``on_ragged='error'``, as the
  original reader does); ``'flag'`` keeps its first two fields and sets ``ragged`` (surplus that is one empty field is
  not seen: nothing is lost). A missing text field is NULL;
* ``dataset`` = the folder below the last ``data`` folder of the path; ``cycle`` = the number in a file or folder
  named ``data-<k>`` or ``data-<k>.<ext>`` (NULL when absent);
* ``row_id`` = file index * 2^33 + number of the record in its file, deterministic whatever the partitioning.

A large file is read by many tasks
----------------------------------
Whether a line begins a record depends on all quotes before it. Lines are read in splits (``lineSep`` LF never cuts a character).

1. One pass gives every line, for both states its split may begin in (outside or inside quotes), the state before and after it and the
   number of records begun in the split so far. A line without quotes keeps the state; others are matched once per state. The lines are
   stored, so later steps see the same splits.
2. A split maps the state before it to the one after it: keep, swap, or a constant. An exclusive scan over the splits of a
   file (a row each) gives every split its true state and the number of records before it.
3. A record of one line is parsed where it is. Only lines of records that span lines are grouped, by file and record number; also
   a record over several splits comes together that way, and no other text is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import na_to_null
from ..session import cut_lineage, maybe_broadcast

LABELLED_SCHEMA = "label string, text string, _surplus string"
_NO_VALUE = "\x00"    # no field is read as NULL by its value here: missing-value names are handled below
_OPTIONS = {"header": "false", "multiLine": "true", "quote": '"', "escape": '"', "nullValue": _NO_VALUE, "emptyValue": "", "mode": "PERMISSIVE",
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
DATASET_PATTERN = r"^(?:.*/)?data/([^/]+)/"
CYCLE_PATTERN = r"(?:^|.*/)data-(\d+)(?:\.[^/]*)?(?:/|$)"
_LINE_BITS = 33
# a line from outside quotes that ends inside: whole fields, then one that is not closed
_ENDS_INSIDE = re.compile(rb'(?:(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+)?,)*+"(?:[^"]++|"")*+')
_LINES = ("file_path string, block long, line long, before0 boolean, before1 boolean, after0 boolean, after1 boolean, "
          "record0 long, record1 long, value binary")


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to ``file_path, block, value`` of lines in file order what each line is if its block begins outside (0) or inside (1)
    quotes: the states before and after it, and the number of the record it belongs to, from 1 (0: one of a block before)."""
    place, line = None, 0
    state, records = [False, True], [0, 0]
    for b in batches:
        quoted = pc.greater(pc.count_substring(b.column(2), b'"'), 0).to_pylist()
        blank = pc.or_(pc.equal(b.column(2), b""), pc.equal(b.column(2), b"\r")).to_pylist()
        out: list[list] = [[] for _ in range(7)]
        for k, here in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            if here != place:
                place, line, state, records = here, 0, [False, True], [0, 0]
            before = list(state)
            for s in (0, 1):
                records[s] += not before[s] and not blank[k]
            if quoted[k]:
                value = b.column(2)[k].as_py()
                ends = {inside: _ENDS_INSIDE.fullmatch(b'"' + value if inside else value) is not None for inside in set(before)}
                state = [ends[x] for x in before]
            for column, x in zip(out, (line, *before, *state, *records)):
                column.append(x)
            line += 1
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(out[0], pa.int64()), *(pa.array(c, pa.bool_()) for c in out[1:5]),
             *(pa.array(c, pa.int64()) for c in out[5:]), b.column(2)], [f.split()[0] for f in _LINES.split(", ")])


def _block_states(lines: DataFrame) -> DataFrame:
    """``file_path, block, inside, records_before``: the true state and record number each block begins with (a row a block)."""
    last = lines.groupBy("file_path", "block").agg(F.max_by(F.struct("after0", "after1", "record0", "record1"), "line").alias("s")).select("file_path", "block", "s.*")
    order = Window.partitionBy("file_path").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("after0") == F.col("after1")
    last = last.withColumn("swaps", F.sum((F.col("after0") & ~F.col("after1")).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    known = F.last(F.when(fixed, F.struct(F.col("after0").cast("long").alias("state"), "swaps")), ignorenulls=True).over(earlier)
    swaps = F.coalesce(F.last("swaps").over(earlier), F.lit(0))
    inside = (F.coalesce(known["state"], F.lit(0)) + swaps - F.coalesce(known["swaps"], F.lit(0))) % 2 == 1
    last = last.withColumn("inside", inside)
    begun = F.when(F.col("inside"), F.col("record1")).otherwise(F.col("record0"))
    return last.select("file_path", "block", "inside", F.coalesce(F.sum(begun).over(earlier), F.lit(0)).alias("records_before"))


def _records(spark: SparkSession, paths) -> DataFrame:
    """``file_path, record`` (from 1) and the record's ``raw`` text, bytes as they are in the file."""
    read = spark.read.option("lineSep", "\n").text(paths)
    lines = cut_lineage(read.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"),
                                    F.col("value").cast("binary").alias("value")).mapInArrow(_follow, _LINES), "csv-lines")
    blocks = cut_lineage(_block_states(lines), "csv-blocks")
    pick = lambda name: F.when(F.col("inside"), F.col(name + "1")).otherwise(F.col(name + "0"))
    placed = (lines.join(maybe_broadcast(blocks, blocks.count()), ["file_path", "block"])
              .select("file_path", "block", "line", pick("before").alias("before"), pick("after").alias("after"),
                      (F.col("records_before") + pick("record")).alias("record"), F.col("value").cast("string").alias("value")))
    one_line = ~F.col("before") & ~F.col("after")
    single = placed.where(one_line & ~F.col("value").isin("", "\r")).select("file_path", "record", F.col("value").alias("raw"))
    parts = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    several = (placed.where(~one_line).groupBy("file_path", "record").agg(parts.alias("parts"))
               .select("file_path", "record", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("raw")))
    return single.unionByName(several).withColumn("raw", F.when(F.col("raw").endswith("\r"), F.expr("left(raw, length(raw) - 1)")).otherwise(F.col("raw")))


def read_labelled_csv(spark: SparkSession, paths, on_bad_bytes: str = "replace", with_row_id: bool = True,
                      on_ragged: str = "error") -> DataFrame:
    """``(row_id, label, text, dataset, cycle, file_path[, ragged][, bad_bytes])``."""
    if on_ragged not in ("error", "flag"):
        raise ValueError(f"unknown on_ragged {on_ragged!r}")
    if on_bad_bytes not in ("replace", "quarantine", "error"):
        raise ValueError(f"unknown on_bad_bytes {on_bad_bytes!r}")
    rows = _records(spark, paths)
    df = (rows.select("file_path", "record", (~F.is_valid_utf8("raw")).alias("bad_bytes"),
                      F.from_csv(F.make_valid_utf8("raw"), LABELLED_SCHEMA, _OPTIONS).alias("row"))
          .select("file_path", "record", "bad_bytes", na_to_null(F.col("row.label")).alias("label"), na_to_null(F.col("row.text")).alias("text"),
                  F.col("row._surplus").isNotNull().alias("ragged")))
    # not a deterministic condition, so Spark never moves the checks below the choice of records
    placed = F.monotonically_increasing_id() >= 0
    if on_ragged == "error":
        df = (df.where(F.when(F.col("ragged") & placed, F.raise_error(F.concat(F.lit("row with more than two fields in "), F.col("file_path"))))
                       .otherwise(F.lit(True))).drop("ragged"))
    if on_bad_bytes == "error":
        df = df.where(F.when(F.col("bad_bytes") & placed, F.raise_error(F.concat(F.lit("invalid UTF-8 in record "), F.col("record").cast("string"),
                                                                        F.lit(" of "), F.col("file_path")))).otherwise(F.lit(True)))
    if on_bad_bytes != "quarantine":
        df = df.drop("bad_bytes")
    ds = F.regexp_extract("file_path", DATASET_PATTERN, 1)
    cyc = F.regexp_extract("file_path", CYCLE_PATTERN, 1)
    df = (df.withColumn("dataset", F.when(ds != "", ds))
          .withColumn("cycle", F.when(cyc != "", cyc.cast("int"))))
    if not with_row_id:
        return df.drop("record")
    files = (rows.select("file_path").distinct()
             .withColumn("_file", F.dense_rank().over(Window.orderBy("file_path")) - 1))  # one row per file
    return (df.join(files, "file_path")
            .withColumn("row_id", F.shiftleft(F.col("_file").cast("long"), _LINE_BITS) + F.col("record") - 1)
            .drop("record", "_file"))


def ingest(spark: SparkSession, paths, out: str, **kw) -> DataFrame:
    """Scan once and keep the result as Parquet; later jobs read the Parquet copy."""
    read_labelled_csv(spark, paths, **kw).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def write_labelled_csv(df: DataFrame, path: str) -> None:
    """Write ``(label, text)`` as the headerless CSV layout above (whitespace kept, quotes doubled)."""
    (df.select("label", "text").write.mode("overwrite").option("header", False).option("quote", '"')
     .option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def sentence_frame(spark: SparkSession, sentences) -> DataFrame:
    """Literal sentences as ``(idx, text)`` (the ad hoc single-sentence path; ``idx`` = input order)."""
    return spark.createDataFrame([(i, s) for i, s in enumerate(sentences)], "idx long, text string")
