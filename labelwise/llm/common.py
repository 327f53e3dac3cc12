"""Helpers shared by the operators: input normalisation, stored tables and vectorised word hashing.

The hashing helpers work on the raw UTF-8 buffers of an Arrow batch, so no Python object is made per word.
Words are ``[^\\x20\\x09-\\x0D]+`` (maximal runs without ASCII white space), unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import read_table

CHUNK_BYTES = 2 << 20   # bytes of text whose hash arrays are alive at once (one longer text goes alone)
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240613))
_BYTE = _rng.integers(0, 2 ** 64, 256, dtype=_U)      # a random 64-bit code for each byte value
_STEP = _U(0x9E3779B97F4A7C15)
_SEEDS = _rng.integers(0, 2 ** 64, (2, 8), dtype=_U) | _U(1)     # odd factors and offsets of the two hashes
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under ``spark.checkpoint.dir`` and read back (survives executor loss)."""
    return cut_lineage(df, name)


def texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with a null text as the empty text; other columns are dropped."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (column names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_row_hash(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a hash of each text (null: empty) in a new column, and its name. Rows that are equal in
    doc_id and this hash have equal results."""
    name = free_name(docs, "row_hash")
    return docs.withColumn(name, F.xxhash64(F.coalesce(F.col("text"), F.lit("")))), name


def fold(col: Column | str, parts: int) -> Column:
    """``crc32(doc_id as text) mod parts``; a null id is in fold 0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % parts, F.lit(0))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def utf8(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the ``len + 1`` offsets of its values in them (null: empty)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.type != pa.large_string():
        arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64, len(arr) + 1, arr.offset * 8) if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges ``[a, b)`` of whole texts with at most ``limit`` bytes each (a longer text is alone)."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of consecutive texts, and the ``len + 1`` word offsets of the texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = _SPACE[data]
    cut = np.zeros(n + 1, bool)        # a text starts here
    cut[off] = True
    cut[0] = cut[n] = True
    before, after = cut[:-1].copy(), cut[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    word = ~space
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, wide: bool = False) -> np.ndarray:
    """A 64-bit hash of each of the ascending, disjoint, non-empty spans of bytes: the sum of pseudo-random values, one
    for each byte at each place. ``wide``: two independent ones, as rows."""
    if not len(starts):
        return np.zeros((2, 0) if wide else 0, _U)
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
    code = mix(_BYTE[data[np.repeat(starts, size) + place]] + place.astype(_U) * _STEP)
    one = mix(np.add.reduceat(code, first) + size.astype(_U))
    if not wide:
        return one
    return np.stack([one, mix(np.add.reduceat(mix(code + _SEEDS[1, 0]), first) + size.astype(_U))])


class SpanHash:
    """64-bit hashes of any span of a sequence of word hashes in O(1). Level ``k`` holds the hash of the ``2 ** k``
    words from each place on, made of the two halves; a span is made of the two blocks of the largest level inside it, which
    together cover it. Every step is a non-linear mix, so no pattern of words cancels out. ``seed`` 0 or 1: independent hashes."""

    def __init__(self, words: np.ndarray, seed: int = 0):
        self.seeds = _SEEDS[seed]
        self.levels = [words]

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            front = last[:max(len(last) - half, 0)]
            self.levels.append(mix(mix(front * self.seeds[1] + self.seeds[2]) + last[half:] * self.seeds[3]))
        return self.levels[k]

    def __call__(self, start: np.ndarray, length) -> np.ndarray:
        start = np.asarray(start)
        size = np.broadcast_to(np.asarray(length), start.shape)
        out = np.zeros(start.shape, _U)
        log = np.frexp(np.maximum(size, 1))[1] - 1
        for k in range(int(log.max(initial=-1)) + 1):
            at = np.flatnonzero((log == k) & (size > 0)) if np.ndim(length) else slice(None) if log.flat[0] == k else None
            if at is None or not len(start[at]):
                continue
            level, s, n = self._level(k), start[at], size[at]
            out[at] = mix(mix(level[s] * self.seeds[4] + n.astype(_U) * self.seeds[5]) + level[s + n - (1 << k)] * self.seeds[6])
        return out


def hashed_words(arr: pa.Array, wide: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per chunk of texts ``[a, b)``: their word hashes, concatenated (``wide``: two rows), and the word offsets of the texts."""
    data, off = utf8(arr)
    for a, b in chunks(off):
        part, o = data[off[a]:off[b]], off[a:b + 1] - off[a]
        starts, ends, woff = word_spans(part, o)
        yield a, b, word_hashes(part, starts, ends, wide), woff


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values (log2(width) passes)."""
    if len(x) < width:
        return x[:0]
    have, m = 1, x
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[:len(x) - width + 1], m[width - have:]) if have < width else m


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the (first) minimum of every ``width`` consecutive values (log2(width) passes)."""
    if len(x) < width:
        return np.zeros(0, np.int64)

    def first(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(x[b] < x[a], b, a)

    have, m = 1, np.arange(len(x))
    while have * 2 <= width:
        m = first(m[:-have], m[have:])
        have *= 2
    return first(m[:len(x) - width + 1], m[width - have:]) if have < width else m
