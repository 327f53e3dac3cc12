"""Substring duplicates by a sparse suffix array.

1. Of all suffixes of all texts (by words) only those at content-selected positions are retained: the minimiser of each
   window of ``window`` words (``shared_runs``). Equal passages of a window or more retain equal suffixes.
2. Suffixes whose first words (the minimiser's gram) occur in one document only have no partner and are dropped.
3. The rest is sorted by the ``window`` words from the position on (range partitions, so no common passage is in one
   task), each with the ``window`` words before it. Every suffix is compared with its neighbour of another document; the
   match is extended to the right and to the left. The few rows at the partitions' edges are compared in a step of
   their own.
4. What a suffix's few neighbours do not show is settled exactly. The runs of windows around the shared suffixes are
   indexed by the hash of all their words with their two smallest doc_ids. Where runs with different words share a
   minimiser, the first document's copy of each is taken apart and its windows are indexed in the same way. So no
   span and no smallest doc_id depends on how many suffixes lie between two partners.
5. Matches of ``window`` words and more are joined to maximal spans of each document.

Nulls: a null text has no words, a row with a null doc_id takes no part. Rows with an equal doc_id count as one document
and do not match each other. Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SpanHash, hashed_words, mix, shuffle_parts, stored
from .shared_runs import GRAM, WINDOW, Runs

NEIGHBOURS = 4     # rows before a suffix that it is compared with, besides the last one of another document
_KEY = ["doc_id", "row_hash"]
_U = np.uint64


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row_hash"), text.alias("text"))


def _positions(words: np.ndarray, woff: np.ndarray, runs: Runs, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs and word positions (inside their texts) of their minimisers: the leftmost that is in all windows of the
    run; in a repetitive run without one, every occurrence."""
    span = SpanHash(words[0])
    base = woff[runs.doc]
    first, last = base + runs.first, base + runs.last
    at = np.full(len(first), -1)
    for k in range(window - gram + 1):
        p = last + k
        ok = np.flatnonzero((at < 0) & (p <= first + window - gram))
        hit = ok[span(p[ok], gram) == runs.anchor[ok]]
        at[hit] = p[hit]
    which, places = [np.flatnonzero(at >= 0)], [at[at >= 0]]
    for r in np.flatnonzero(at < 0):
        p = np.arange(first[r], last[r] + window - gram + 1)
        p = p[span(p, gram) == runs.anchor[r]]
        which.append(np.full(len(p), r))
        places.append(p)
    run = np.concatenate(which)
    return run, np.concatenate(places) - base[run]


def _anchors(rows: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, words, woff in hashed_words(b.column(2), wide=True):
                r = Runs(words, woff, window, gram)
                run_, at = _positions(words, woff, r, window, gram) if len(r.doc) else (r.doc, r.doc)
                # a row for each text and anchor, with all its places and runs
                order = np.lexsort((at, r.anchor[run_], r.doc[run_]))
                run_, at = run_[order], at[order]
                doc, anchor = r.doc[run_], r.anchor[run_]
                new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]))) if len(doc) else doc
                places = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)), pa.int32()), pa.array(at.astype(np.int32)))
                by = np.lexsort((r.first, r.anchor, r.doc))
                d, a = r.doc[by], r.anchor[by]
                each = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (a[1:] != a[:-1]))) if len(d) else d
                runs = pa.StructArray.from_arrays([pa.array(r.first[by].astype(np.int32)), pa.array(r.last[by].astype(np.int32)),
                                                   pa.array(r.block[by].view(np.int64))], ["first", "last", "block"])
                runs = pa.ListArray.from_arrays(pa.array(np.append(each, len(by)), pa.int32()), runs)
                take = pa.array(doc[new], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(take), b.column(1).slice(lo, hi - lo).take(take),
                                                  places, pa.array(anchor[new].view(np.int64)), runs],
                                                 ["doc_id", "row_hash", "places", "anchor", "runs"])

    return rows.mapInArrow(run, "doc_id long, row_hash long, places array<int>, anchor long, "
                                "runs array<struct<first:int,last:int,block:long>>")


def _two_least(pairs: DataFrame, *key: str) -> DataFrame:
    """The two smallest ``doc`` of each key: ``one`` and ``two`` (null: there is one only). Limited before the shuffle."""
    ranked = pairs.select(*key, "doc", F.dense_rank().over(Window.partitionBy(key[0]).orderBy("doc")).alias("_n")).where("_n <= 2")
    return (ranked.groupBy(*key).agg(F.min("doc").alias("one"), F.max("doc").alias("_z"))
            .select(*key, "one", F.when(F.col("_z") > F.col("one"), F.col("_z")).alias("two")))


_SUFFIX = ("doc_id long, row_hash long, at int, n_right int, n_left int, right binary, left binary, "
           "open array<struct<lo:int,hi:int,block:long,two:long>>")
_NAMES = ["doc_id", "row_hash", "at", "n_right", "n_left", "right", "left", "open"]
_OPEN = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("block", pa.int64()), ("two", pa.int64())]))


def _carried(places: np.ndarray, open_runs: list[dict] | None) -> list[list[tuple] | None]:
    """For each place (ascending) the window starts of ``open_runs`` up to it and after the place before."""
    out: list[list[tuple] | None] = [None] * len(places)
    for r in open_runs or []:
        s = np.arange(r["first"], r["last"] + 1)
        to = np.searchsorted(places, s)
        cut = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        for i, j in zip(cut, np.append(cut[1:], len(s))):
            if out[to[i]] is None:
                out[to[i]] = []
            out[to[i]].append((int(s[i]), int(s[j - 1]), r["block"], r["two"]))
    return out


def _suffixes(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The retained suffixes: the hashes of the next and (backwards) of the previous ``window`` words, all first quarters before
    the second ones and so on: texts that share n words share the first 2n bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, places, opened = b.column(0), b.column(1), b.column(3), b.column(4).to_pylist()
            for lo, hi, words, woff in hashed_words(b.column(2)):
                at = [np.sort(x.values.to_numpy()) for x in places.slice(lo, hi - lo)]
                doc = np.repeat(np.arange(hi - lo), [len(x) for x in at])
                here = np.concatenate([np.zeros(0, np.int64), *at]).astype(np.int64)
                carried = [c for x, o in zip(at, opened[lo:hi]) for c in _carried(x, o)]
                padded = np.append(words, _U(0))
                spot, end, begin = woff[doc] + here, woff[doc + 1], woff[doc]
                step = np.arange(window)
                right, left = spot[:, None] + step, spot[:, None] - 1 - step
                right = padded[np.where(right < end[:, None], right, len(words))]
                left = padded[np.where(left >= begin[:, None], left, len(words))]
                quarters = lambda m: np.hstack([m >> _U(s) & _U(0xFFFF) for s in (48, 32, 16, 0)]).astype(">u2")
                pack = lambda m: pa.array([x.tobytes() for x in quarters(m)], pa.binary())
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo).take(take), keys.slice(lo, hi - lo).take(take), pa.array(here.astype(np.int32)),
                     pa.array(np.minimum(window, end - spot).astype(np.int32)), pa.array(np.minimum(window, spot - begin).astype(np.int32)),
                     pack(right), pack(left), pa.array(carried, _OPEN)], _NAMES)

    return (rows.join(wanted.hint("shuffle_hash"), _KEY).select(*_KEY, "text", "places", "open").mapInArrow(run, _SUFFIX))


def _open_windows(t: pa.Table, window: int) -> list[np.ndarray] | None:
    """``doc, row, start, hash, block, two, fresh`` of the windows carried by suffix rows. ``fresh``: the first of equal windows of a document."""
    t = t.filter(pc.is_valid(t.column("open"))).combine_chunks()
    if not t.num_rows:
        return None
    block = _Block(t, window)
    runs = t.column("open").combine_chunks()
    row = np.repeat(np.arange(t.num_rows), pc.list_value_length(runs).to_numpy(zero_copy_only=False))
    flat = runs.flatten()
    lo, hi, of = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3))
    two = flat.field(3)
    has, two = two.is_valid().to_numpy(zero_copy_only=False), two.fill_null(0).to_numpy(zero_copy_only=False)
    size = hi - lo + 1
    each = np.repeat(np.arange(len(row)), size)
    start = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
    row_ = row[each]
    k = window - (block.at[row_] - start)
    words = sum(np.hstack([block.left[:, q, ::-1], block.right[:, q]]).astype(_U) << _U(48 - 16 * q) for q in range(4))
    hashes = SpanHash(words.ravel())(row_ * (2 * window) + k, window).view(np.int64)
    doc, of, has, two = block.doc[row_], of[each], has[each], two[each]
    order = np.lexsort((two, has, hashes, doc))
    same = [x[order][1:] == x[order][:-1] for x in (doc, hashes, has, two)]
    fresh = np.ones(len(order), bool)
    fresh[order[1:]] = ~np.logical_and.reduce(same)
    return [doc, block.row[row_], start, hashes, of, pa.array(two, pa.int64(), mask=~has), fresh]


class _Block:
    """Sorted suffix rows as arrays."""

    def __init__(self, b: pa.RecordBatch | pa.Table, window: int):
        self.doc, self.row, self.at, self.n_right, self.n_left = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
        self.right, self.left = (np.frombuffer(b"".join(b.column(i).to_pylist()), ">u2").reshape(-1, 4, window) for i in (5, 6))

    def matches(self, window: int, fresh: int = 0) -> list[np.ndarray]:
        """``doc, row, first, last, other`` (words ``first`` .. ``last`` - 1) of both sides of matching neighbours: the rows
        from number ``fresh`` on with the ``NEIGHBOURS`` rows before them and the last row of another document."""
        n = len(self.doc)
        new = np.append(True, self.doc[1:] != self.doc[:-1]) if n else np.zeros(0, bool)
        every = np.arange(n)
        partners = [np.maximum.accumulate(np.where(new, every, 0)) - 1, *(every - k for k in range(1, NEIGHBOURS + 1))]
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
        for partner in partners:
            cur = np.flatnonzero((partner >= 0) & (every >= fresh) & (self.doc != self.doc[np.maximum(partner, 0)]))
            partner = partner[cur]

            def common(m: np.ndarray, size: np.ndarray) -> np.ndarray:
                same = (m[cur] == m[partner]).all(1)
                return np.minimum(np.where(same.all(1), window, same.argmin(1)), np.minimum(size[cur], size[partner]))

            r, l = common(self.right, self.n_right), common(self.left, self.n_left)
            hit = r + l >= window
            r, l, a, b = r[hit], l[hit], cur[hit], partner[hit]
            both, other = np.append(a, b), np.append(b, a)
            for x, y in zip(out, [self.doc[both], self.row[both], self.at[both] - np.append(l, l), self.at[both] + np.append(r, r), self.doc[other]]):
                x.append(y)
        got = np.unique(np.stack([np.concatenate(x) for x in out], 1), axis=0)      # a pair may be met twice
        return [got[:, i] for i in range(5)]


_MATCH = ["doc_id", "row_hash", "first", "last", "other"]


def _compare(sorted_rows: DataFrame, window: int) -> DataFrame:
    """Matches of neighbours inside the partitions, and the partitions' ``NEIGHBOURS`` first and last rows (``edge`` set)."""
    names = _NAMES[:-1]
    schema = pa.schema([*((c, pa.int64()) for c in _MATCH), ("edge", pa.int64()), ("n_right", pa.int32()),
                        ("n_left", pa.int32()), ("at", pa.int32()), ("right", pa.binary()), ("left", pa.binary()),
                        ("hash", pa.int64()), ("block", pa.int64()), ("two", pa.int64()), ("fresh", pa.bool_())])
    of_window = [schema.get_field_index(c) for c in ("doc_id", "row_hash", "first", "hash", "block", "two", "fresh")]

    def filled(n: int, columns: dict[int, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[i] if i in columns else pa.nulls(n, f.type) for i, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carry, head = TaskContext.get().partitionId(), None, 0

        def edge(t: pa.Table) -> pa.RecordBatch:
            row = {c: t.column(c).combine_chunks() for c in names}
            row["edge"] = pa.array([part] * t.num_rows, pa.int64())
            return filled(t.num_rows, {schema.get_field_index(c): x for c, x in row.items()})

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            windows = _open_windows(t, window)
            if windows is not None:
                yield filled(len(windows[0]), {i: x if isinstance(x, pa.Array) else pa.array(x) for i, x in zip(of_window, windows)})
            t = t.select(names)
            if head < NEIGHBOURS:
                yield edge(t.slice(0, NEIGHBOURS - head))
                head += min(t.num_rows, NEIGHBOURS - head)
            joined = pa.concat_tables([carry, t]).combine_chunks() if carry is not None else t
            block = _Block(joined, window)
            got = block.matches(window, joined.num_rows - t.num_rows)
            n = len(got[0])
            if n:
                yield filled(n, {i: pa.array(x) for i, x in enumerate(got)})
            # the last rows, and before them the last one of another document
            d = block.doc
            last = np.arange(max(0, len(d) - NEIGHBOURS), len(d))
            other = np.flatnonzero(d != d[-1])[-1:]
            carry = joined.take(pa.array(np.union1d(other, last)))
        if carry is not None:
            yield edge(carry.slice(max(0, carry.num_rows - NEIGHBOURS)))

    out = ("doc_id long, row_hash long, first long, last long, other long, edge long, n_right int, n_left int, at int, right binary, "
           "left binary, hash long, block long, two long, fresh boolean")
    return sorted_rows.mapInArrow(run, out)


def _settled(runs: DataFrame, blocks: DataFrame, windows: DataFrame, window: int) -> DataFrame:
    """All repeated runs, and all repeated windows of runs that one document has, with the smallest other document."""
    docs = lambda *c: F.explode(F.array_compact(F.array(*c))).alias("doc")
    known = stored(_two_least(windows.where("fresh").select("hash", docs("doc_id", "two")), "hash").where("two is not null")
                   .select("hash", "one", F.col("two").alias("next")), "known_windows")
    got = windows.select(*_KEY, "first", "hash", "block", "two").join(known, "hash")
    other = F.when(F.col("one") == F.col("doc_id"), F.col("next")).otherwise(F.col("one")).alias("other")
    single = got.where("two is null").select(*_KEY, "first", (F.col("first") + window).alias("last"), other)
    # of a run that several documents have, the two smallest of all its windows
    least = _two_least(got.where("two is not null").select("block", docs("one", "next")), "block")
    index = stored(blocks.where("two is not null").select("block", "one", "two").unionByName(least)
                   .groupBy("block").agg(F.min("one").alias("one"), F.min("two").alias("next")), "index")
    whole = runs.join(index, "block").select(*_KEY, F.col("first").cast("long").alias("first"),
                                             (F.col("last") + window).cast("long").alias("last"), other)
    return whole.unionByName(single)


def duplicate_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, row_hash, first_word, n_words, other_doc_id, earlier``: maximal spans that another document has too. ``other_doc_id`` is the
    smallest other document that has ``window`` words of the span; ``earlier``: it has a smaller doc_id."""
    parts = max(2, shuffle_parts(docs.sparkSession))
    rows = _rows(docs)
    anchors = stored(_anchors(rows, window, gram), "anchors")
    # stored, so that both sides of the join are plain exchanges, which Spark can split where an anchor is hot
    shared = stored(anchors.groupBy("anchor").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_z"))
                    .where("_a < _z").select("anchor"), "shared_anchors")
    common = stored(anchors.join(shared, "anchor"), "common_anchors")
    runs = common.select(*_KEY, "places", F.inline("runs"))
    blocks = stored(_two_least(common.select(F.explode(F.array_distinct("runs.block")).alias("block"), "anchor", F.col("doc_id").alias("doc")),
                               "block", "anchor"), "blocks")
    # an anchor with one content only has nothing left to take apart
    mixed = (blocks.groupBy("anchor").agg(F.min("block").alias("_a"), F.max("block").alias("_z")).where("_a < _z").select("anchor"))
    to_open = stored(blocks.join(mixed, "anchor").select("block", "one", "two"), "open_blocks")
    opened = (runs.join(to_open, "block").where("doc_id = one")
              .select(*_KEY, "places", F.struct("first", "last", "block", "two").alias("open")))
    wanted = (opened.groupBy(*_KEY).agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.array_distinct(F.collect_list("open")).alias("open")))
    order = ["right", "left", "doc_id", "at"]
    # the ranges' bounds are sampled, so their key is short: upper halves, and no more words to the left than there can be
    # between the beginning of a passage and its first minimiser
    upper = [F.substring(F.col("right"), 1, 2 * window), F.substring(F.col("left"), 1, 2 * (window - gram))]
    ranged = _suffixes(rows, wanted, window).repartitionByRange(parts, *upper, "doc_id").sortWithinPartitions(*order)
    found = stored(_compare(ranged, window), "matches")
    edges = found.where("edge is not null").select("edge", *_NAMES[:-1])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]       # a few rows of each partition
        if tables:
            t = pa.concat_tables(tables).combine_chunks()
            got = _Block(t.drop_columns(["edge"]), window).matches(window)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], _MATCH)

    at_edges = (edges.repartition(1).sortWithinPartitions(*order)
                .mapInArrow(across, "doc_id long, row_hash long, first long, last long, other long"))
    near = found.where("other is not null").select(*_MATCH).unionByName(at_edges).distinct()
    spans = near.unionByName(_settled(runs, blocks, found.where("hash is not null"), window))
    text_order = Window.partitionBy(*_KEY).orderBy("first", "last")
    reached = F.max("last").over(text_order.rowsBetween(Window.unboundedPreceding, -1))
    grouped = (spans.withColumn("new", F.coalesce((F.col("first") > reached).cast("int"), F.lit(1)))
               .withColumn("span", F.sum("new").over(text_order.rowsBetween(Window.unboundedPreceding, 0))))
    return (grouped.groupBy(*_KEY, "span")
            .agg(F.min("first").alias("first_word"), (F.max("last") - F.min("first")).alias("n_words"), F.min("other").alias("other_doc_id"))
            .select("doc_id", "row_hash", "first_word", "n_words", "other_doc_id", (F.col("other_doc_id") < F.col("doc_id")).alias("earlier")))
