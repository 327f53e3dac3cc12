"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

1. The n-grams of a text: one to ``GRAM`` code points of its lower-cased words (runs of letters), each word with a boundary on
   both sides. An n-gram is one 64-bit integer (21 bits a code point): nothing is hashed, no two n-grams meet.
2. ``fit`` counts the n-grams of every language over all texts it may learn from (counted in the tasks, added by a shuffle
   of counts) and keeps the ``size`` most frequent of each, ranked from 0; ties by the integer. That is one profile a language.
3. ``predict`` ranks the ``size`` most frequent n-grams of every whole text likewise; equally frequent ones share their mean
   rank, so a short text is not ranked by the alphabet. The out-of-place distance to a profile is the mean over
   these n-grams of the difference of the two ranks, ``size`` for an n-gram that the profile lacks. The nearest language wins, ties by name.
   ``score`` is its distance's relative distance to the next one's (1 - nearest / next; with one language 1 - distance / ``size``).

A text too long for one array is counted by parts that overlap by a gram. Profiles are sent to the tasks in slices of ``SLICE``
languages, so what is broadcast is bounded whatever the number of languages; each slice is one more pass.

Nulls and texts without a letter are ``und`` with score 0 and teach nothing; rows with a null ``lang`` or id are not learnt
from; if nothing was learnt every row is ``und`` with score 0. Copies and repeated rows count as often as they stand in the table and get equal
results. Empty tables give empty results. Other columns are kept by ``predict``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, stored

GRAM = 3                 # longest n-gram: three code points fill an integer
SIZE = 400               # n-grams of a profile and of a text that are ranked
SLICE = 1024             # languages that are compared in one pass
PART = 1 << 20           # code points that are counted at once
FLUSH = 1 << 20          # counts a task holds before it passes them on
UNKNOWN = "und"
_EDGE = 1                # the boundary of a word (a control character, so no letter)
_BITS = 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _points(text: str) -> np.ndarray:
    """Lower-cased letters of a text with single boundaries around its words; empty if it has no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return np.zeros(0, np.int64)
    c = np.concatenate([[_EDGE], np.where(letter, c, _EDGE), [_EDGE]]).astype(np.int64)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != _EDGE) | (c[:-1] != _EDGE)
    return c[keep]


def grams(text: str, part: int = PART) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, ascending, and their counts."""
    points = _points(text)
    found = []
    for a in range(0, len(points), part):
        c = points[a:a + part + GRAM - 1]          # grams that start in this part
        n = min(part, len(c))
        pair = c[:-1] << _BITS | c[1:]
        first = c[:n]
        keys = [first[first != _EDGE], pair[:n], (pair[:-1] << _BITS | c[2:])[:n][c[1:-1][:n] != _EDGE]]
        found.append(np.unique(np.concatenate(keys), return_counts=True))
    return _added(found)


def _added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(found) == 1:
        return found[0]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, inverse, np.concatenate([n for _, n in found]))
    return keys, total


def ranks(keys: np.ndarray, counts: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` most frequent n-grams and their ranks from 0; equally frequent ones share their mean rank."""
    order = np.argsort(-counts, kind="stable")[:size]
    n = counts[order]
    cut = np.flatnonzero(np.diff(n)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(n)]])
    return keys[order], np.repeat((first + last - 1) / 2, last - first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, gram, n`` of the texts of a task."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, found in held.items():
            keys, n = _added(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            found = grams(text.as_py())
            held.setdefault(lang, []).append(found)
            size += len(found[0])
        if size > FLUSH:
            held = {lang: [_added(found)] for lang, found in held.items()}
            size = sum(len(f[0][0]) for f in held.values())
            if size > FLUSH // 2:
                yield from out()
                held, size = {}, 0
    yield from out()


@dataclass
class Profiles:
    """``lang, gram, rank`` (a stored table) and the number of languages."""

    table: DataFrame
    languages: int
    size: int = SIZE


def fit(docs: DataFrame, learn_from: Callable = lambda doc_id: F.lit(True), size: int = SIZE) -> Profiles:
    """The profiles of all values of ``lang``, from the texts of the rows with ``learn_from(doc_id)``."""
    known = (docs.where("doc_id is not null and lang is not null and text is not null").where(learn_from(F.col("doc_id")))
             .select(F.col("lang").cast("string").alias("lang"), "text"))
    counts = known.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    table = stored(counts.withColumn("rank", place - 1).where(F.col("rank") < size).select("lang", "gram", "rank"), "profiles")
    return Profiles(table, table.select("lang").distinct().count(), size)


@dataclass
class Compare:
    """Profiles of some languages, as one sorted list of n-grams and a matrix of ranks."""

    langs: list[str]
    grams: np.ndarray
    ranks: np.ndarray      # languages x grams, -1 where a profile lacks the n-gram
    size: int

    def distances(self, keys: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.grams, keys)
        at[at == len(self.grams)] = 0
        known = self.grams[at] == keys
        own = self.ranks[:, at]
        away = np.where((own >= 0) & known, np.abs(own - rank), self.size)
        return away.mean(axis=1)


def predict(docs: DataFrame, model: Profiles, lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """All columns of ``docs`` and the predicted language and its score."""
    spark = docs.sparkSession
    size = model.size
    best, near, after = (free_name(docs, c) for c in ("best_lang", "best_distance", "next_distance"))
    rows = docs.select("*", F.lit(None).cast("string").alias(best), F.lit(None).cast("double").alias(near),
                       F.lit(None).cast("double").alias(after))
    text_at = docs.columns.index("text")
    names = model.table.select("lang").distinct()
    last = None
    for _ in range(0, model.languages, SLICE):
        own = (names if last is None else names.where(F.col("lang") > last)).orderBy("lang").limit(SLICE)
        got = model.table.join(F.broadcast(own), "lang").collect()        # at most SLICE x size rows
        langs = sorted({r.lang for r in got})
        last = langs[-1]
        keys = np.unique(np.array([r.gram for r in got], np.int64))
        matrix = np.full((len(langs), len(keys)), -1.0)
        row = {lang: k for k, lang in enumerate(langs)}
        matrix[[row[r.lang] for r in got], np.searchsorted(keys, [r.gram for r in got])] = [r.rank for r in got]
        given = spark.sparkContext.broadcast(Compare(langs, keys, matrix, size))

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            compare = given.value
            for b in batches:
                out = [], [], []
                for text, *old in zip(b.column(text_at), *(c.to_pylist() for c in b.columns[-3:])):
                    text = text.as_py()
                    keys, counts = grams(text) if text else ((), ())
                    if len(keys):
                        d = compare.distances(*ranks(keys, counts, size))
                        before = [(x, lang) for x, lang in ((old[1], old[0]), (old[2], None)) if x is not None]
                        # earlier slices hold the lesser names, so they come first where distances tie
                        found = sorted(before + [(d[k], compare.langs[k]) for k in np.argsort(d, kind="stable")[:2]], key=lambda f: f[0])
                        old = [found[0][1], found[0][0], found[1][0] if len(found) > 1 else None]
                    for column, value in zip(out, old):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()),
                                                  pa.array(out[2], pa.float64())], b.schema.names)

        rows = rows.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(best, T.StringType()), T.StructField(near, T.DoubleType()),
                                                  T.StructField(after, T.DoubleType())]))
    second = F.coalesce(F.col(after), F.lit(float(size)))
    score = F.when(F.col(best).isNull() | (second <= 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.col(near) / second))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), F.coalesce(best, F.lit(UNKNOWN)).alias(lang_out), score.alias(score_out))
