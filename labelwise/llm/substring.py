"""Substring dedup by an exact index of content-selected blocks and windows (in place of a relative Lempel-Ziv parse).

A window is ``window`` consecutive words of a document. A word goes if a window that covers it also starts in a
document with a smaller doc_id. Texts are looked up in all documents with smaller ids:

1. Content-selected blocks (``shared_runs``): every text is cut, with overlaps, into blocks of at least ``window``
   words that begin and end where its content says. All blocks of all documents are indexed by their hash and
   by the hash of the anchor inside them; every index entry keeps its smallest doc_id.
2. A block whose hash an earlier document has is repeated as a whole; neighbouring ones overlap or touch and join.
   No text is factored greedily into (reference, position, length).
3. Boundaries: a block that has only its anchor in common with another document may hold the
   beginning or the end of a common passage. Its windows, and those of the first block with each other
   content at that anchor, are compared in cells of up to 8 neighbouring windows. A cell whose words an earlier document
   has goes whole; one whose windows' common words no other document has holds nothing that is repeated. Only
   the windows of the cells between, where a passage begins or ends, are compared one by one. A cell that a text has at
   several places is one row with these places.

Copies are never paired: an index entry is an aggregate (smallest doc_id), combined before the shuffle. Entries are
stored before they are joined, so that both sides of a join are plain exchanges, which Spark can split where an entry is hot.
Blocks, cells and windows are equal if 128 bits of two independent hashes are (of independent hashes of their words); anchors
and common words of cells, which only choose what is compared, have 64.

Nulls: a null text has no words; a row with a null doc_id keeps all its words and is no reference. Rows with an
equal doc_id count as one document for each other (they never remove each other's words). Other columns are
ignored. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, free_name, hashed_words, stored, with_row_hash
from .shared_runs import CELL, WINDOW, Cells, Runs

_BLOCK, _PART, _HASH = ["block", "block2"], ["part", "part2"], ["hash", "hash2"]     # 128 bits each
_KEY = ["doc_id", "row_hash"]     # identifies a row: rows equal in both have equal results


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row_hash"), text.alias("text"))


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _parse(rows: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """From one pass over the texts: a row for each text (``n_words``, digest of all words) and its blocks."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int64()), ("n_words", pa.int64()),
                        ("digest", pa.string()), ("first", pa.int32()), ("last", pa.int32()),
                        ("anchor", pa.int64()), ("block", pa.int64()), ("block2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, texts = b.column(0), b.column(1), b.column(2)
            for lo, hi, words, woff in hashed_words(texts, wide=True):
                r = Runs(words, woff, window)
                all_words = [_digest(t.as_py().encode().split()) for t in texts[lo:hi]]
                n, m, at = hi - lo, len(r.doc), pa.array(r.doc)
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([ids[lo:hi], ids[lo:hi].take(at)]), pa.concat_arrays([keys[lo:hi], keys[lo:hi].take(at)]),
                     pa.concat_arrays([pa.array(np.diff(woff), pa.int64()), pa.nulls(m, pa.int64())]),
                     pa.concat_arrays([pa.array(all_words, pa.string()), pa.nulls(m, pa.string())]),
                     pa.concat_arrays([none.cast(pa.int32()), pa.array(r.first, pa.int32())]),
                     pa.concat_arrays([none.cast(pa.int32()), pa.array(r.last, pa.int32())]),
                     *(pa.concat_arrays([none, _signed(x)]) for x in (r.anchor, r.block, r.block2))], schema=schema)

    got = stored(rows.mapInArrow(run, "doc_id long, row_hash long, n_words long, digest string, first int, last int, "
                                      "anchor long, block long, block2 long"), "blocks")
    return (got.where("digest is not null").select(*_KEY, "n_words", "digest"),
            got.where("anchor is not null and doc_id is not null").select(*_KEY, "first", "last", "anchor", "block", "block2"))


def _cells(rows: DataFrame, open_blocks: DataFrame, window: int) -> DataFrame:
    """The windows of the blocks that are compared below block level, in cells of up to ``CELL`` neighbouring ones. A row is a cell's content in
    a text: its ``places`` there (first window starts), ``n`` windows, ``part, part2`` of all words, ``core`` of the words that all windows have,
    and ``hashes`` of the windows inside the block, the first of which is ``skip`` after the cell's. Where a cell begins follows from each of
    its windows alone, so equal windows have equal cores."""
    wanted = open_blocks.groupBy(*_KEY).agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    pair = pa.struct([("hash", pa.int64()), ("hash2", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int64()), ("places", pa.list_(pa.int32())), ("n", pa.int32()),
                        ("core", pa.int64()), ("part", pa.int64()), ("part2", pa.int64()), ("skip", pa.int32()), ("hashes", pa.list_(pair))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, spans = b.column(0), b.column(1), b.column(3).to_pylist()
            for lo, hi, words, woff in hashed_words(b.column(2), wide=True):
                doc, at = [], []
                for k in range(hi - lo):
                    for first, last in sorted((s["first"], s["last"]) for s in spans[lo + k]):
                        at.append(np.arange(first, last + 1))
                        doc.append(np.full(len(at[-1]), k))
                if not doc:
                    continue
                doc, at = np.concatenate(doc), np.concatenate(at)
                span = [SpanHash(words[i], i) for i in (0, 1)]
                c = Cells(span[0], woff, doc, woff[doc] + at, window)
                n, skip = c.last - c.first + 1, at[c.begin[:-1]] - c.first
                part, part2 = (h(woff[c.doc] + c.first, n + window - 1) for h in span)
                key = [c.doc, part, part2, skip, np.diff(c.begin), woff[c.doc] + c.first - c.core]
                order = np.lexsort((c.first, *key))
                new = np.ones(len(order), bool)
                new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in key], axis=0)
                group = np.flatnonzero(new)
                one, take = order[group], pa.array(c.doc[order[group]])
                pairs = pa.StructArray.from_arrays([_signed(h(woff[doc] + at, window)) for h in span], fields=list(pair))
                yield pa.RecordBatch.from_arrays(
                    [ids[lo:hi].take(take), keys[lo:hi].take(take),
                     pa.ListArray.from_arrays(pa.array(np.append(group, len(order)), pa.int32()), pa.array(c.first[order], pa.int32())),
                     pa.array(n[one], pa.int32()), _signed(span[0](c.core[one], window - CELL + 1)), _signed(part[one]), _signed(part2[one]),
                     pa.array(skip[one], pa.int32()), pa.ListArray.from_arrays(pa.array(c.begin, pa.int32()), pairs).take(pa.array(one))],
                    schema=schema)

    return (rows.join(wanted.hint("shuffle_hash"), _KEY).select(*_KEY, "text", "spans")
            .mapInArrow(run, "doc_id long, row_hash long, places array<int>, n int, core long, part long, part2 long, skip int, "
                             "hashes array<struct<hash: long, hash2: long>>"))


def duplicate_spans(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The normalised rows, their word counts and digests, and the duplicate spans
    ``doc_id, row_hash, places, n`` of every row: ``n`` windows from each of ``places`` on."""
    rows = _rows(docs)
    plain, blocks = _parse(rows, window)
    anchors = stored(blocks.groupBy("anchor").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_z"))
                     .where("_a < _z").select("anchor"), "anchors")
    common = stored(blocks.join(anchors, "anchor"), "common_blocks")
    index = stored(common.groupBy(*_BLOCK).agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("_z"))
                   .where("first_doc < _z").select(*_BLOCK, "first_doc"), "index")
    parsed = common.join(index, _BLOCK, "left")
    factors = (parsed.where("first_doc < doc_id")
               .select(*_KEY, F.array("first").alias("places"), (F.col("last") - F.col("first") + 1).alias("n")))
    # an anchor with one content only has nothing left to compare
    mixed = stored(common.groupBy("anchor").agg(F.min(F.struct(*_BLOCK)).alias("_a"), F.max(F.struct(*_BLOCK)).alias("_z"))
                   .where("_a < _z").select("anchor"), "mixed_anchors")
    rest = parsed.where("first_doc is null or first_doc = doc_id").join(mixed, "anchor")
    cells = stored(_cells(rows, rest, window), "cells")
    # a window can only be repeated where the words that it has in common with its cell are
    cores = stored(cells.groupBy("core").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_z"),
                                             F.min(F.struct(*_PART)).alias("_b"), F.max(F.struct(*_PART)).alias("_y"))
                   .where("_a < _z").select("core", (F.col("_b") < F.col("_y")).alias("mixed")), "cores")
    shared = stored(cells.join(cores, "core").drop("core"), "shared_cells")
    parts = stored(shared.groupBy(*_PART).agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("_z"))
                   .where("first_doc < _z").select(*_PART, "first_doc"), "known_cells")
    compared = stored(shared.join(parts, _PART, "left").drop(*_PART), "compared_cells")
    whole = compared.where("first_doc < doc_id").select(*_KEY, "places", "n")
    windows = stored(compared.where("mixed and (first_doc is null or first_doc = doc_id)")
                     .select(*_KEY, "places", "skip", F.posexplode("hashes"))
                     .select(*_KEY, "places", (F.col("skip") + F.col("pos")).alias("skip"), "col.hash", "col.hash2"), "windows")
    known = stored(windows.groupBy(*_HASH).agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("_z"))
                   .where("first_doc < _z").select(*_HASH, "first_doc"), "known_windows")
    single = (windows.join(known, _HASH).where("first_doc < doc_id")
              .select(*_KEY, F.transform("places", lambda x: x + F.col("skip")).alias("places"), F.lit(1).alias("n")))
    return rows, plain, factors.unionByName(whole).unionByName(single)


def _changed(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Word counts and digests of all rows; of the rows that lose words ``n_removed, digest_kept, kept``."""
    rows, plain, spans = duplicate_spans(docs, window)
    cuts = spans.groupBy(*_KEY).agg(F.collect_list(F.struct("places", "n")).alias("spans"))
    schema = pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int64()), ("n_removed", pa.int64()),
                        ("digest_kept", pa.string()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, key, text, found in zip(*(b.column(i).to_pylist() for i in range(4))):
                words = text.encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                for s in found:
                    at = np.array(s["places"])
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + s["n"] + window - 1, -1)
                kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                out.append((doc, key, len(words) - len(kept), _digest(kept), b" ".join(kept).decode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    changed = (rows.join(cuts.hint("shuffle_hash"), _KEY).select(*_KEY, "text", "spans")
               .mapInArrow(run, "doc_id long, row_hash long, n_removed long, digest_kept string, kept string")
               .dropDuplicates(_KEY))     # repeated rows
    return plain, changed


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row: of the words that are left, joined by one space."""
    plain, changed = _changed(docs, window)
    return (plain.join(changed.drop("kept"), _KEY, "left")
            .select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                    F.coalesce("digest_kept", "digest").alias("kept_sha256")))


def clean(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with its columns; a text that loses words is the words that are left, joined by one space (and
    ``n_chars``, where there is such a column, their length). Other texts stay as they are."""
    _, changed = _changed(docs, window)
    keyed, row_hash = with_row_hash(docs)
    kept = free_name(keyed, "kept")
    id_, hash_ = free_name(keyed, "kept_id"), free_name(keyed, "kept_hash")
    new = changed.select(F.col("doc_id").alias(id_), F.col("row_hash").alias(hash_), F.col("kept").alias(kept))
    joined = keyed.join(new, (keyed["doc_id"] == new[id_]) & (keyed[row_hash] == new[hash_]), "left")
    values = {"text": F.coalesce(F.col(kept), F.col("text"))}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(
            F.char_length(F.col(kept)).cast(docs.schema["n_chars"].dataType))
    return joined.select(*(values.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
