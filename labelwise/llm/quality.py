"""Quality classifier: nearest-neighbour voting on latent-semantic vectors.

1. Terms of a text: hashed words, bigrams of character classes and word-, line- and length-shape terms (``term_counts``).
   One pass over all texts sums document frequencies and the term Gram matrix (``TERMS`` short rows from
   each partition, added up by term); with inverse document frequencies its eigenvectors are the latent
   space.
2. At most ``per_class`` labelled rows of each class (the smallest hashes of their ids) are projected and
   broadcast: at most ``2 * per_class`` short vectors whatever the input.
3. Every text is projected and its cosines with all labelled vectors are computed in blocks, exactly. The
   ``neighbours`` nearest, and all that are as near as the last of them, vote with the weight of their similarity; classes are weighted back to their share
   among the labelled rows, so the score estimates the probability of label 1.

Only ids that ``docs`` holds are drawn; of rows that repeat a drawn id the least text is learnt from.
Nulls: a null text is the empty text; an empty text has no neighbours and gets the share of label 1. Rows
with a null label or id are not learnt from. Without labelled rows every score is 0.5. Repeated rows are
scored alike. Empty tables give empty results. ``score`` keeps all columns of its input, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, utf8, word_hashes, word_spans

PER_CLASS = 2048
NEIGHBOURS = 15
DIMENSIONS = 64
SHARPNESS = 32.0       # a neighbour's weight is its cosine to this power

_SIGNS = [b" ", b"\t\n\r\x0b\x0c", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789",
          bytes(range(128, 256)), b".", b",", b"!", b"?", b"|", b"%", b"*", b"#", b"$", b"&", b"'\"`",
          b"()[]{}<>", b"-_/\\+=~^", b":;@"]
_CLASS = np.full(256, len(_SIGNS), np.int64)
for _i, _s in enumerate(_SIGNS):
    _CLASS[list(_s)] = _i
_K = len(_SIGNS) + 1
_PAIRS = _K * _K
_LENGTHS = 12          # word lengths 1..11 and longer
_SIZES = 10            # number of words, by powers of 4
_SHAPES = 6            # repeated words (next, next but one, in the text), lines, repeated lines, upper case words
SHAPE_WEIGHT = 3.0     # these few terms against the many bigrams
WORDS = 512            # buckets of hashed words
TERMS = WORDS + _PAIRS + _LENGTHS + _SIZES + _SHAPES


def _repeats(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Per text, how many of its hashes occurred before in the same text."""
    key = np.sort(doc.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
    again = key[1:][key[1:] == key[:-1]] >> np.uint64(40)
    return np.bincount(again.astype(np.int64), minlength=n)


def term_counts(texts: pa.Array) -> Iterator[np.ndarray]:
    """Dense ``(texts, TERMS)`` arrays of log(1 + count), by chunks of the array."""
    data, off = utf8(texts)
    for a, b in chunks(off):
        part, o, n = data[off[a]:off[b]], off[a:b + 1] - off[a], b - a
        out = np.zeros((n, TERMS))
        cls = _CLASS[part]
        doc = np.repeat(np.arange(n), np.diff(o))
        if len(cls) > 1:
            same = doc[1:] == doc[:-1]
            pair = (doc[:-1] * _PAIRS + cls[:-1] * _K + cls[1:])[same]
            out[:, WORDS:WORDS + _PAIRS] = np.bincount(pair, minlength=n * _PAIRS).reshape(n, _PAIRS)
        starts, ends, woff = word_spans(part, o)
        words = word_hashes(part, starts, ends)
        wdoc, count = np.repeat(np.arange(n), np.diff(woff)), np.diff(woff)
        bucket = (words >> np.uint64(33)).astype(np.int64) % WORDS
        out[:, :WORDS] = np.bincount(wdoc * WORDS + bucket, minlength=n * WORDS).reshape(n, WORDS)
        length = np.minimum(ends - starts, _LENGTHS) - 1
        at = WORDS + _PAIRS
        out[:, at:at + _LENGTHS] = np.bincount(wdoc * _LENGTHS + length, minlength=n * _LENGTHS).reshape(n, _LENGTHS)
        at += _LENGTHS
        size = np.minimum(np.log2(count + 1) / 2, _SIZES - 1).astype(np.int64)
        out[np.arange(n), at + size] = count > 0
        at += _SIZES
        for k, lag in enumerate((1, 2)):
            if len(words) > lag:
                hit = (words[lag:] == words[:-lag]) & (wdoc[lag:] == wdoc[:-lag])
                out[:, at + k] = np.bincount(wdoc[lag:][hit], minlength=n)
        out[:, at + 2] = _repeats(wdoc, words, n)
        newline = part == 10
        ledge = np.zeros(len(part) + 1, bool)
        ledge[o] = True
        ledge[:-1] |= newline
        lstart = np.flatnonzero(ledge[:-1])
        if len(lstart):
            lend = np.append(lstart[1:], len(part))
            first = lstart + newline[lstart]
            keep = lend > first
            ldoc = doc[lstart][keep]
            out[:, at + 3] = np.bincount(ldoc, minlength=n)
            out[:, at + 4] = _repeats(ldoc, word_hashes(part, first[keep], lend[keep]), n)
        upper = np.zeros(n)
        if len(starts):
            upper = np.bincount(wdoc[(cls[starts] == 3) & (cls[ends - 1] != 2)], minlength=n)
        out[:, at + 5] = upper
        yield np.log1p(out)


@dataclass
class Model:
    """``project``: terms -> latent space (idf included); labelled unit vectors, labels, class weights."""

    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    share: float

    def latent(self, terms: np.ndarray) -> np.ndarray:
        x = (terms @ self.project).astype(np.float32)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, terms: np.ndarray, neighbours: int = NEIGHBOURS, block: int = 256) -> np.ndarray:
        out = np.full(len(terms), self.share)
        if not len(self.vectors):
            return out
        some = terms.any(axis=1)
        k = min(neighbours, len(self.vectors))
        for a in range(0, len(terms), block):
            cos = self.latent(terms[a:a + block]) @ self.vectors.T
            last = -np.partition(-cos, k - 1, axis=1)[:, k - 1:k]
            row, near = np.nonzero(cos >= last)                     # as near as the last of the ``k``: all vote
            w = np.maximum(cos[row, near], 1e-6).astype(np.float64) ** SHARPNESS * self.weights[near]
            voted = np.bincount(row, w * self.labels[near], len(cos)) / np.bincount(row, w, len(cos))
            out[a:a + block] = np.where(some[a:a + block], voted, self.share)
        return out


def _sums(docs: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of texts, document frequencies and Gram matrix of the terms, over all texts."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df, gram = 0, np.zeros(TERMS), np.zeros((TERMS, TERMS))
        for b in batches:
            for x in term_counts(b.column(0)):
                n, df, gram = n + len(x), df + (x > 0).sum(0), gram + x.T @ x
        if n:   # a row for each term: the matrices of all partitions are added up term by term
            rows = [np.append(df, n).tobytes(), *(np.append(g, 0).tobytes() for g in gram)]
            yield pa.RecordBatch.from_pydict({"term": pa.array(range(TERMS + 1)), "sums": rows})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for term, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[term] = total.get(term, 0) + np.frombuffer(x)
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(total), pa.int64()),
                                          "sums": pa.array([x.tobytes() for x in total.values()], pa.binary())})

    fields = "term long, sums binary"
    parts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(part, fields)
    rows = parts.repartition("term").mapInArrow(add, fields).collect()   # one matrix of TERMS columns
    total = np.zeros((TERMS + 1, TERMS + 1))
    for r in rows:
        total[r.term] += np.frombuffer(r.sums)
    return int(total[0, -1]), total[0, :-1], total[1:, :-1]


def fit(docs: DataFrame, labels: DataFrame, label: str, learn_from: Callable = lambda doc_id: F.lit(True),
        per_class: int = PER_CLASS, dimensions: int = DIMENSIONS) -> Model:
    """Learns the latent space from all ``docs`` and the labelled vectors from ``labels`` (``doc_id``, ``label``),
    rows with ``learn_from(doc_id)`` only."""
    n, df, gram = _sums(docs)
    idf = np.log((n + 1) / (df + 1)) + 0.05 * (df > 0)
    idf[-_SHAPES:] *= SHAPE_WEIGHT
    values, basis = np.linalg.eigh(gram * idf[:, None] * idf[None])
    project = idf[:, None] * basis[:, ::-1][:, :dimensions]

    known = (labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
             .where(learn_from(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
             .join(docs.select("doc_id"), "doc_id", "left_semi"))
    shares = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    draw = F.xxhash64("doc_id", F.lit("quality"))
    sample = None
    for y in sorted(shares):
        own = known.where(F.col("y") == y).orderBy(draw, "doc_id").limit(per_class)
        sample = own if sample is None else sample.unionByName(own)
    if sample is None:
        return Model(project, np.zeros((0, dimensions), np.float32), np.zeros(0), np.zeros(0), 0.5)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.concatenate([*term_counts(b.column(1))])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x @ project])], ["y", "x"])

    rows = (docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
            .join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("y", "text").mapInArrow(vectors, "y int, x binary").collect())
    total = sum(shares.values())
    share = shares.get(1, 0) / total
    if not rows:
        return Model(project, np.zeros((0, dimensions), np.float32), np.zeros(0), np.zeros(0), share)
    x, y = np.array([np.frombuffer(r.x) for r in rows]), np.array([r.y for r in rows], float)
    order = np.lexsort((*x.T[:4], y))
    x, y = x[order], y[order]
    drawn = np.bincount(y.astype(int), minlength=2)
    weights = np.array([(shares.get(c, 0) / total) / max(1, drawn[c]) for c in (0, 1)])[y.astype(int)]
    unit = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    return Model(project, unit, y, weights / weights.max(), share)


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``out``, the probability of label 1 (0 to 1)."""
    given = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = np.concatenate([given.value.score(x) for x in term_counts(b.column(at))])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.clip(s, 0, 1))], [*b.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))
