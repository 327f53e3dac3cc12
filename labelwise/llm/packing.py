"""Best-fit packing: bulk-synchronous best-fit of token pieces into sequences of at most ``max_len`` tokens.

1. Each text is tokenised once (Arrow batches); only texts longer than ``max_len`` are cut, the short
   remainder first. The small piece table is stored.
2. Sizes are integers of at most ``max_len``, and pieces of one size, like gaps of one size, are
   interchangeable. So pieces and gaps, range-sorted by size, are runs of a size class. Sizes are served
   from the largest down, each in supersteps: a successor sweep matches its pieces with the smallest gaps
   that are large enough, each gap with at most one piece a superstep; the rank of a piece inside its size
   decides which pieces get the gaps; the gaps are updated; if no gap is left, as many sequences as the rest
   needs are opened; repeat. The sweep sees one count per size -- at most ``max_len`` numbers whatever the
   input -- and yields runs ``(size, first rank, count, first sequence, offset)``.
3. Every piece gets its rank inside its size class by a distributed two-level ranking (no class, however
   common, is in one task) and looks up its run.

Nulls: a null text is the empty text (one token: the end id). Repeated rows are separate documents. A null
doc_id is kept. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts, stored, texts

MAX_LEN = 2048
END_ID = 0
ADDED = "<|endoftext|>"   # the vocabulary's added token; its id follows those of the merges
SEGMENT_CHARS = 1 << 20   # a longer text is tokenised by parts, cut where a token surely starts
_SHIFT = 44               # bits of a rank inside a size class


class Encoder:
    """Byte-level BPE ids (as little-endian uint32 bytes) by a file of ranks; the end-of-text mark inside a text is its
    one added token, as in the vocabulary's JSON form."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                     special_tokens={ADDED: max(ranks.values()) + 1})
        self.raw = partial(encoding.encode, allowed_special="all")

    def ids(self, text: str) -> bytes:
        return b"".join(array("I", self.raw(part)).tobytes() for part in segments(text))


def segments(text: str) -> Iterator[str]:
    """A text in parts of about ``SEGMENT_CHARS``. The pre-tokeniser's pattern joins at most one space to the
    word after it, so the ids are the same when a text is cut before a space with a non-space on both sides
    (the added token holds no space)."""
    at = 0
    while len(text) - at > SEGMENT_CHARS:
        p = text.find(" ", at + SEGMENT_CHARS)
        while p >= 0 and (p + 1 >= len(text) or text[p - 1].isspace() or text[p + 1].isspace()):
            p = text.find(" ", p + 1)
        if p < 0:
            break
        yield text[at:p]
        at = p
    yield text[at:]


def cut(n: int, max_len: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` tokens: whole, or the remainder and then full pieces."""
    first = n if n <= max_len else n % max_len or max_len
    return [(0, first)] + [(s, max_len) for s in range(first, n, max_len)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, max_len: int = MAX_LEN) -> DataFrame:
    """One row per piece of every text: its ids by the rank file ``tokenizer``, then the end id."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = Encoder(tokenizer), array("I", [END_ID]).tobytes()
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = enc.ids(text.as_py()) + end
                rows += [(doc, k, s, n, zlib.crc32(ids[4 * s:4 * (s + n)]))
                         for k, (s, n) in enumerate(cut(len(ids) // 4, max_len))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema) \
                if rows else pa.RecordBatch.from_pylist([], schema=schema)

    return texts(docs).mapInArrow(run, PIECES)


def sweep_plan(counts: dict[int, int], max_len: int) -> np.ndarray:
    """Runs ``(size, first rank, count, first sequence, offset)`` of a whole packing.

    Best fit in supersteps over size classes, see the module. ``counts``: pieces per size, 1..max_len."""
    gaps: dict[int, list[tuple[int, int]]] = {}            # gap -> runs of sequences (first, count)
    order: list[int] = []                                  # the gaps, ascending
    runs, opened = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if gap:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:                                        # a superstep: one sweep over the gaps from ``size`` up
            fresh, i = [], bisect.bisect_left(order, size)
            while left and i < len(order):
                g = order[i]
                first, m = gaps[g].pop()
                c = min(left, m)                           # the next ``c`` ranks get these gaps
                runs.append((size, rank, c, first, max_len - g))
                fresh.append((g - size, first, c))
                if m > c:
                    gaps[g].append((first + c, m - c))
                if not gaps[g]:
                    del gaps[g], order[i]
                rank, left = rank + c, left - c
            if left and not any(g >= size for g, _, _ in fresh):
                c = -(-left // (max_len // size))          # no gap is left: open what the rest needs
                c = min(c, left)
                runs.append((size, rank, c, opened, 0))
                fresh.append((max_len - size, opened, c))
                opened, rank, left = opened + c, rank + c, left - c
            for x in fresh:
                put(*x)
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds ``rank``: 0-based position inside the size class. Each class is dealt over hash buckets; a rank is
    the bucket's offset plus the position inside the bucket."""
    buckets = max(16, shuffle_parts(pieces.sparkSession))
    p = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = p.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")
    return (p.withColumn("_r", F.row_number().over(inside) - 1).join(offsets, ["length", "_b"])
            .withColumn("rank", F.col("_r") + F.col("_o")).drop("_b", "_r", "_o"))


def pack(docs: DataFrame, tokenizer: str, max_len: int = MAX_LEN) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of ``docs``.

    ``sequence_id`` is dense from 0; offsets inside a sequence are gapless from 0."""
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, tokenizer, max_len), "pieces")
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}   # <= max_len rows
    plan = sweep_plan(counts, max_len)
    given = spark.sparkContext.broadcast((plan[:, 0] << _SHIFT | plan[:, 1], plan))   # runs of size classes
    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, runs = given.value
        for b in batches:
            if not b.num_rows:
                continue
            size, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            r = runs[np.searchsorted(keys, size << _SHIFT | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in out.names[:5]), pa.array(r[:, 3] + rank - r[:, 1]), pa.array(r[:, 4])], schema=out)

    cols = [x.split()[0] for x in PIECES.split(", ")]
    return ranked(pieces).select(*cols, F.col("rank").cast("long").alias("rank")).mapInArrow(
        place, PIECES + ", sequence_id long, offset long")
