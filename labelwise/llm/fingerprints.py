"""Document fingerprints from modular prefix arrays.

The prefix array of a text holds, for two bases modulo the prime 2^31 - 1, the polynomial hashes of all its prefixes. The
hash of any span follows from two entries, so spans are compared in O(1) and the longest common extension of two
positions is found by binary search (``PrefixArrays``).

The fingerprint of a text is ``length-hash-sketch``: its number of code points, the hash of the whole text, and a
sketch of the hashes of its spans: all spans of ``SPAN`` code points and its first ``SPAN - 1`` prefixes, each with the
number of its occurrence, are dealt over ``BINS`` bins by hash; a bin keeps its smallest value. Equal texts have equal
fingerprints; the share of equal bins estimates the Jaccard likeness of the multisets of spans.

Nulls: a null text is the empty text. Rows are ordered by descending doc_id, a null id last, rows with the same id by
text; the row after the last is the first (of a single row: itself). Repeated rows are documents of their own.
Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, shuffle_parts

PRIME = (1 << 31) - 1
BASES = (1_000_003, 744_731_881)
SPAN = 12
BINS = 64
CHUNK_CHARS = 1 << 19
_U = np.uint64
_P = _U(PRIME)
_EMPTY = 0xFFFF


def _mod(x: np.ndarray) -> np.ndarray:
    """Modulo the Mersenne prime, for values below 2**63."""
    high, x = x >> _U(31), x & _P
    x += high
    np.right_shift(x, _U(31), out=high)
    x &= _P
    x += high
    return np.minimum(x, x - _P)       # unsigned: x - _P wraps around where x is smaller


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a - b`` modulo the prime, for values below it."""
    d = a - b
    return np.minimum(d, d + _P)


class _Powers:
    def __init__(self, base: int):
        self.up, self.down, self.base, self.inv = np.ones(1, _U), np.ones(1, _U), base, pow(base, -1, PRIME)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, _mod(self.up * _U(pow(self.base, m, PRIME)))])
            self.down = np.concatenate([self.down, _mod(self.down * _U(pow(self.inv, m, PRIME)))])
        return self.up, self.down


_POWERS = [_Powers(b) for b in BASES]


class PrefixArrays:
    """Prefix hashes of several texts, laid end to end. Positions are global; ``start`` has each text's first."""

    def __init__(self, texts: list[str]):
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.doc = np.repeat(np.arange(len(texts)), self.size)
        n = len(self.codes)
        self.local = np.arange(n) - self.start[self.doc]
        longest = int(self.size.max(initial=0)) + 1
        self.sums, self.down = [], []
        for p in _POWERS:
            up, down = p.upto(longest)
            s = np.zeros(n + 1, _U)
            np.cumsum(_mod((self.codes.astype(_U) + _U(1)) * up[self.local]), out=s[1:])   # below 2**31 * n
            self.sums.append(_mod(s))
            self.down.append(down)

    def hash(self, text: np.ndarray, at: np.ndarray, length) -> np.ndarray:
        """62-bit hashes of the spans of ``length`` at local positions ``at`` of the texts with these numbers."""
        i = self.start[text] + at
        h = [_mod(_less(s[i + length], s[i]) * d[at]) for s, d in zip(self.sums, self.down)]
        return h[0] << _U(31) | h[1]

    def every(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Text numbers and hashes of all spans of ``length``."""
        n = max(0, len(self.codes) - length + 1)
        inside = np.flatnonzero(self.local[:n] + length <= self.size[self.doc[:n]])
        h = [_mod(_less(s[length:], s[:n]) * d[self.local[:n]]) if n else s[:0] for s, d in zip(self.sums, self.down)]
        return self.doc[inside], (h[0] << _U(31) | h[1])[inside]

    def equal(self, a, i, b, j, length) -> np.ndarray:
        """Whether the spans of ``length`` at ``i`` of text ``a`` and at ``j`` of text ``b`` are equal."""
        return self.hash(a, i, length) == self.hash(b, j, length)

    def extension(self, a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common extension to the right, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.size[a] - i, self.size[b] - j)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(a, i, b, j, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def sketches(self) -> np.ndarray:
        """``(texts, BINS)`` smallest 16-bit values of the span hashes in each bin."""
        out = np.full(len(self.size) * BINS, _EMPTY, np.uint32)
        every = np.arange(len(self.size))
        found = [self.every(SPAN)]
        for n in range(1, SPAN):
            own = every[self.size >= n]
            found.append((own, self.hash(own, np.zeros(len(own), np.int64), n) ^ _U(n << 55)))
        doc, h = (np.concatenate(x) for x in zip(*found))
        key = np.sort(doc.astype(_U) << _U(40) | mix(h) >> _U(24))
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        turn = np.arange(len(key)) - np.repeat(new, np.diff(np.append(new, len(key))))     # first, second .. occurrence
        v = mix((key & _U((1 << 40) - 1)) + (turn.astype(_U) << _U(40)))
        np.minimum.at(out, (key >> _U(40)).astype(np.int64) * BINS + (v >> _U(58)).astype(np.int64),
                      ((v >> _U(20)) % _U(_EMPTY)).astype(np.uint32))
        return out.reshape(-1, BINS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bins among those that are not empty in both, row by row; of two empty sketches: 1."""
    used = (a != _EMPTY) | (b != _EMPTY)
    return np.where(used.any(1), (used & (a == b)).sum(1) / np.maximum(used.sum(1), 1), 1.0)


def _strings(p: PrefixArrays, sketches: np.ndarray) -> list[str]:
    every = np.arange(len(p.size))
    whole = p.hash(every, np.zeros(len(every), np.int64), p.size)
    return [f"{n:x}-{h:016x}-{s.astype('>u2').tobytes().hex()}" for n, h, s in zip(p.size.tolist(), whole.tolist(), sketches)]


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of the next text."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def _results(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Of ``(doc_id, text, next text)`` rows, where the next text is mostly the next row's."""
    a = 0
    while a < len(rows):
        b, size = a, 0
        while b < len(rows) and (b == a or size + len(rows[b][1]) <= CHUNK_CHARS):
            size += len(rows[b][1])
            b += 1
        part, n = rows[a:b], b - a
        edited = [edited_text(t, x) for _, t, x in part]
        texts, following = [*(t for _, t, _ in part), *edited], []
        for k, (_, _, x) in enumerate(part):                # the next text is mostly the next row's own
            if k + 1 < n and part[k + 1][1] is x:
                following.append(k + 1)
            else:
                following.append(len(texts))
                texts.append(x)
        p = PrefixArrays(texts)
        s, text = p.sketches(), np.arange(n)
        names = _strings(p, s)
        none = np.zeros(n, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in part], pa.int64()), pa.array(p.size[:n]),
             pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in edited]),
             pa.array(names[:n]), pa.array(names[n:2 * n]),
             pa.array(likeness(s[:n], s[n:2 * n])), pa.array(likeness(s[:n], s[following])),
             pa.array(p.extension(text, none, text + n, none))],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"])
        a = b


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, common_prefix long")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_prefix`` of
    every text, its edited text and the next document. ``common_prefix``: of the text and its edited text.

    Documents are dealt over ranges of doc_id; the first of each range also goes to the range before it, so every
    range has all its neighbours and texts are shuffled once."""
    spark, parts = docs.sparkSession, max(2, shuffle_parts(docs.sparkSession))
    lowest = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("doc_id", F.lit(lowest)).alias("id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keyed = rows.withColumn("place", F.col("id").cast("double"))
    cuts = sorted(set(keyed.approxQuantile("place", [k / parts for k in range(1, parts)], 0.2 / parts)))   # ``parts`` numbers
    if not cuts:
        return spark.createDataFrame([], RESULT)      # no rows
    ranges = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="place", outputCol="range").transform
    # the first row of each range: ``parts`` rows at most
    heads = sorted((r.range, r.id) for r in ranges(keyed.select("id", "place")).groupBy("range").agg(F.max("id").alias("id")).collect())
    guests = [(i, heads[k + 1][0] if k + 1 < len(heads) else heads[0][0]) for k, (_, i) in enumerate(heads)]
    guest = F.broadcast(spark.createDataFrame(guests, "id long, host double"))
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("guest"))
    other = F.struct(F.col("host").alias("range"), F.lit(1).alias("guest"))
    dealt = (ranges(keyed).join(guest, "id", "left")
             .select("doc_id", "id", "text", F.explode(F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, other))).alias("at"))
             .select("at.range", "at.guest", "doc_id", "id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, done = None, None, True       # the row whose next one is still to come; its range; whether that is over
        for b in batches:
            ready = []
            for r, is_guest, doc, text in zip(*(c.to_pylist() for c in b.columns)):
                if r != at:
                    at, last, done = r, None, False
                if last is not None and not done:
                    ready.append((*last, text))
                if is_guest:
                    done = True                 # only the first of the next range is a neighbour
                else:
                    last = (doc, text)
            yield from _results(ready)

    placed = dealt.repartitionById(parts, F.col("range").cast("int")).sortWithinPartitions("range", "guest", F.desc("id"), "text")
    return placed.select("range", "guest", "doc_id", "text").mapInArrow(run, RESULT)
