"""N-gram Jaccard join by MinHash banding, verified exactly.

Texts are sets of five-word shingles (whitespace words, unchanged; a shorter text is one shingle). Two documents are
linked if the Jaccard similarity of their sets is at least ``threshold``.

1. One pass computes a class key of 128 bits from the shingles' 64-bit hashes (equal sets are one class, so copies are handled
   once) and ``trees`` bands of MinHash values.
2. The bands' length is fixed before any text is read: the longest with 1 - (1 - threshold^depth)^trees >= ``recall``
   (``prefix_depth``: 5 values for the constants here). There are no sorted tries and no prefix is shortened by the data.
3. Classes that share the hash of a band are candidates. They are never paired: each is tied to the smallest
   class of its prefix, and the ties' components are candidate groups.
4. A group is split into blocks of about ``BLOCK`` texts, fewer if they are long, and every two of its blocks meet in one task, which computes all
   exact similarities between them at once, from the words themselves. It returns a row for each text: the number of its links and the
   smallest class it is connected to. Groups of any size are whole; tasks stay bounded.
5. Components of the verified links are the near-duplicate classes.

Nulls and empty texts have no shingles and no links; their class is their own doc_id. A null doc_id takes part and
is never a class id unless all of the class have none. Repeated rows are documents of their own (they link).
Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, free_name, hashed_words, mix, shuffle_parts, stored, with_row_hash
from .components import components

SHINGLE = 5
THRESHOLD = (4, 5)       # 0.8, as a fraction
TREES = 20
DEPTH = 8
RECALL = 0.999
BLOCK = 192              # texts in a block of a candidate group, on average,
BLOCK_SHINGLES = 1 << 20 # and shingles, unless one text has more
_U = np.uint64
_SEEDS = np.random.Generator(np.random.PCG64(77)).integers(1, 2 ** 63, (TREES * 2, DEPTH), dtype=_U) * _U(2) + _U(1)
_KEYS = ["key", "key2"]
_NO_ID = (1 << 63) - 1
OWN = 2                  # the side of texts that are compared inside their block


def prefix_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix whose forest finds pairs at the threshold with at least this probability."""
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_sets(words: np.ndarray, woff: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of consecutive texts, and the ``len + 1`` offsets of the texts."""
    n, count = len(woff) - 1, np.diff(woff)
    doc = np.repeat(np.arange(n), count)
    span = SpanHash(words)
    at = np.flatnonzero(doc[:len(words) - width + 1] == doc[width - 1:]) if len(words) >= width else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < width))
    who = np.concatenate([doc[at], short])
    what = np.concatenate([span(at, width), span(woff[short], count[short])])
    order = np.lexsort((what, who))
    who, what = who[order], what[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (what[1:] != what[:-1])
    return what[new], np.searchsorted(who[new], np.arange(n + 1))


def exact_sets(texts: list[str], width: int = SHINGLE) -> list[np.ndarray]:
    """The shingle sets of some texts as numbers that are equal where the words are (nothing is hashed)."""
    numbers: dict[bytes, int] = {}
    words = [[numbers.setdefault(w, len(numbers)) for w in t.encode().split()] for t in texts]
    size = np.array([len(w) for w in words])
    flat = np.array([x for w in words for x in w], np.int64)
    ids, span = flat, 1                       # ids: numbers of the ``span`` words from each place on
    for _ in range(width - 1):
        ids, span = np.unique(ids[:-1] << 32 | flat[span:], return_inverse=True)[1], span + 1
    sets, first, top, whole = [], np.cumsum(size) - size, len(flat), {}
    for k, w in enumerate(words):
        if len(w) >= width:
            sets.append(np.unique(ids[first[k]:first[k] + len(w) - width + 1]))
        else:
            sets.append(np.array([top + whole.setdefault(tuple(w), len(whole))] if w else [], np.int64))
    return sets


def _sketch(docs: DataFrame, trees: int, depth: int) -> DataFrame:
    """``doc_id, row_hash, key, key2, shingles, labels`` of every document; the keys (128 bits) are null without shingles."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row_hash"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, words, woff in hashed_words(b.column(2)):
                items, off = shingle_sets(words, woff)
                have = np.flatnonzero(np.diff(off))
                keys, labels = np.zeros((2, hi - lo), _U), np.zeros((hi - lo, trees), _U)
                if len(have):
                    cut = off[have]
                    x = mix(items + _U(1))
                    for k, y in enumerate((x, mix(items ^ _SEEDS[0, 0]))):
                        keys[k, have] = mix(np.add.reduceat(y, cut) + np.diff(off)[have].astype(_U))
                    for t in range(trees):
                        label = np.full(len(have), t + 1, _U)
                        for d in range(depth):
                            least = np.minimum.reduceat(x * _SEEDS[t, d], cut)
                            label = mix(label * _U(0x9E3779B97F4A7C15) + least)
                        labels[have, t] = label
                none = np.ones(hi - lo, bool)
                none[have] = False
                lists = pa.FixedSizeListArray.from_arrays(pa.array(labels.ravel().view(np.int64)), trees).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo),
                                                  *(pa.array(k.view(np.int64), mask=none) for k in keys), pa.array(np.diff(off)), lists],
                                                 ["doc_id", "row_hash", *_KEYS, "shingles", "labels"])

    return rows.mapInArrow(run, "doc_id long, row_hash long, key long, key2 long, shingles long, labels array<long>")


def _link_counts(sets: list[np.ndarray], weight: np.ndarray, side: np.ndarray, node: np.ndarray,
                 threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """For texts of two blocks (``side`` 0 and 1) or of one (``side`` 2): weighted links, and the smallest connected node."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    who = np.repeat(np.arange(n), size)
    items = np.concatenate(sets)
    values, inverse, count = np.unique(items, return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[inverse]
    who, col = who[keep], place[inverse[keep]]
    common = np.zeros((n, n))
    order = np.argsort(col, kind="stable")
    who, col = who[order], col[order]
    for a in range(0, int(shared.sum()), 4096):
        i, j = np.searchsorted(col, (a, a + 4096))
        m = np.zeros((n, 4096), np.float32)
        m[who[i:j], col[i:j] - a] = 1
        common += m @ m.T
    num, den = threshold
    link = common * den >= (size[:, None] + size[None] - common) * num
    link &= ~np.eye(n, dtype=bool) if side[0] == OWN else side[:, None] != side[None]
    links = (link * weight[None]).sum(1).astype(np.int64)
    root = node.copy()
    while True:
        low = np.where(link, root[None], np.iinfo(np.int64).max).min(1)
        new = np.minimum(root, low)
        if (new == root).all():
            return links, root
        root = new


def _verify(tasks: DataFrame, threshold: tuple[int, int], parts: int) -> DataFrame:
    """``node, links, root`` for each row of ``task, side, node, weight, text``."""

    def results(rows: list[tuple]) -> list[tuple]:
        rows = list({(r[0], r[1]): r for r in rows}.values())      # repeated rows of the table
        rows.sort(key=lambda r: (r[0], r[1]))
        side, node = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        sets = exact_sets([r[3] for r in rows])
        links, root = _link_counts(sets, np.array([r[2] for r in rows], float), side, node, threshold)
        return list(zip(node.tolist(), links.tolist(), root.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, out = None, [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["node", "links", "root"])

        for b in batches:
            for key, *row in zip(*(c.to_pylist() for c in b.columns)):
                if key != current and rows:
                    out += results(rows)
                    rows = []
                current = key
                rows.append(tuple(row))
            if len(out) > 5000:
                yield batch()
                out = []
        if rows:
            out += results(rows)
        yield batch()

    by_task = tasks.repartition(parts, "task").sortWithinPartitions("task")
    return by_task.select("task", "side", "node", "weight", "text").mapInArrow(run, "node long, links long, root long")


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, trees: int = TREES, depth: int = DEPTH,
                    recall: float = RECALL) -> DataFrame:
    """``doc_id, row_hash, class_id, class_row, copy_id, n_links`` of every document.

    ``class_id``: smallest doc_id connected by links (``class_row``: that row's hash); ``copy_id``: smallest doc_id with
    the same shingles; ``n_links``: documents linked to this one, copies included."""
    num, den = threshold
    base = stored(_sketch(docs, trees, prefix_depth(num / den, trees, depth, recall)), "sketches")
    row = F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "row_hash")
    classes = stored(base.where("key is not null").groupBy(*_KEYS)
                     .agg(F.min(row).alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("labels").alias("labels"),
                          F.max("shingles").alias("shingles")).withColumn("node", F.monotonically_increasing_id()), "classes")
    entries = classes.select("node", F.explode("labels").alias("label"))
    prefixes = (entries.groupBy("label").agg(F.min("node").alias("least"), F.max("node").alias("_z"))
                .where("least < _z").select("label", "least"))
    ties = entries.join(prefixes, "label").where("node <> least")
    groups = components(ties, "node", "least")
    grouped = (groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
               .join(classes.select("node", "shingles"), "node"))
    sizes = grouped.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("shingles") / BLOCK_SHINGLES))
                                        .cast("int").alias("blocks"))
    member = (grouped.join(sizes, "root")
              .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tasks = (member.select("node", "root", "block", other)
             .select("node", F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("task"),
                     F.when(F.col("block") == F.col("other"), OWN).otherwise((F.col("block") > F.col("other")).cast("int")).alias("side"))
             .join(classes.select("node", "rep", "weight"), "node")
             .select("task", "side", "node", "weight", F.col("rep.id").alias("id"), F.col("rep.row_hash").alias("row_hash")))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("row_hash"), text.alias("text"))
    found = stored(_verify(rows.join(tasks.hint("shuffle_hash"), ["id", "row_hash"]), threshold,
                           max(shuffle_parts(docs.sparkSession), 1)), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found, "node", "root")
    known = (classes.select("node", *_KEYS, "rep", "weight").join(roots, "node", "left")
             .withColumn("root", F.coalesce("root", "node")).join(links, "node", "left"))
    least = known.groupBy("root").agg(F.min("rep").alias("first"))
    known = (known.join(least, "root")
             .select(*_KEYS, "rep", "first", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    given = lambda c: F.when(c != _NO_ID, c)   # noqa: E731 - back to a null id
    return (base.select("doc_id", "row_hash", *_KEYS).join(known, _KEYS, "left")
            .select("doc_id", "row_hash", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(given(F.col("first.id"))).alias("class_id"),
                    F.coalesce("first.row_hash", "row_hash").alias("class_row"),
                    F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(given(F.col("rep.id"))).alias("copy_id"),
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with its columns: of every near-duplicate class the row of the class id; texts without words stay."""
    found = near_duplicates(docs, **settings)
    keyed, row_hash = with_row_hash(docs)
    id_, hash_ = free_name(keyed, "kept_id"), free_name(keyed, "kept_hash")
    kept = (found.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("row_hash") == F.col("class_row")))
            .select(F.col("doc_id").alias(id_), F.col("row_hash").alias(hash_)))
    left = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept[id_]) & (keyed[row_hash] == kept[hash_]), "left_semi")
    # of repeated rows one stays, unless they have no words
    single = free_name(left, "single")
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    left = left.withColumn(single, F.when(has_words, F.lit(-1)).otherwise(F.monotonically_increasing_id()))
    return left.dropDuplicates(["doc_id", row_hash, single]).select(*(F.col(f"`{c}`") for c in docs.columns))
