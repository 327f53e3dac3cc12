"""Merge-type subword encoding with seeded merge-dropout, and its decoder.

The vocabulary of a SentencePiece BPE model (pieces and scores) is used; encoding and decoding are written here. A text
starts as single characters (after a leading space; a space is the space sign of the vocabulary). The agenda holds
all neighbouring symbols whose join is a piece; the best score comes first, of equal scores the leftmost. With dropout,
a candidate is skipped if a hash, keyed by seed, document and the places of its two symbols, falls below the rate: the same
key always gives the same segmentation, other seeds and documents give others. Characters without a piece, and the
space sign itself, become byte pieces; so decoding is lossless for every text.

No piece has a space sign after another character, so texts fall into units (space signs, then other characters) that are
encoded on their own: short ones together by length, one merge of every unit a round (``_short``), long ones one by one
with a heap (``agenda``). Both give the same result.

Nulls: a null text is the empty text and has no ids. Repeated rows get equal ids. A null doc_id has a key of its own.
Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, texts

SEED = 1
RATE = 0.1
SHORT = 48             # characters of a short unit (at most 63)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 48)   # short units are processed together up to each of these
CHUNK_CHARS = 1 << 20
SPACE = "▁"
_U = np.uint64
_NONE = np.iinfo(np.int32).max
_GONE = -9             # a symbol that was joined to the one before


class Vocabulary:
    """Pieces by character and by pair of symbols; ranks follow the scores (equal scores: equal rank)."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        piece = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.raw = [b""] * n                       # what a piece decodes to
        for b, i in enumerate(self.byte.tolist()):
            self.raw[i] = bytes([b])
        for i in plain:
            self.raw[i] = piece[i].replace(SPACE, " ").encode()
        ids = {piece[i]: i for i in plain}
        score = {i: model.get_score(i) for i in plain}
        ranks = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = np.full(n, _NONE, np.int32)
        self.rank[plain] = [ranks[score[i]] for i in plain]
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[ord(" ")], self.char[ord(SPACE)] = self.char[ord(SPACE)], -1
        self.pairs = {(ids[p[:k]], ids[p[k:]]): i for p, i in ids.items() for k in range(1, len(p))
                      if p[:k] in ids and p[k:] in ids}
        self._table()

    def _table(self) -> None:
        """Two hash tables in which every pair is at its place in one of them."""
        self.bits, left = 19, {a << 32 | b: m for (a, b), m in self.pairs.items()}
        self.mult = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
        while True:
            size = 1 << self.bits
            slots: list[dict[int, int]] = [{}, {}]
            place = lambda t, k: (k * self.mult[t] & (1 << 64) - 1) >> (64 - self.bits)
            ok = True
            for key in left:
                t, k = 0, key
                for _ in range(200):
                    s = place(t, k)
                    k, slots[t][s] = slots[t].get(s), k
                    if k is None:
                        break
                    t = 1 - t
                else:
                    ok = False
                    break
            if ok:
                break
            self.bits += 1
        self.keys = [np.full(size, (1 << 64) - 1, np.uint64) for _ in (0, 1)]
        self.merged = [np.full(size, -1, np.int32) for _ in (0, 1)]
        for t in (0, 1):
            for s, k in slots[t].items():
                self.keys[t][s], self.merged[t][s] = k, left[k]

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        key = a.astype(np.uint32).astype(_U) << _U(32) | b.astype(np.uint32).astype(_U)    # no pair has a -1
        s = (key * _U(self.mult[0])) >> _U(64 - self.bits)
        out = np.where(self.keys[0][s] == key, self.merged[0][s], -1)
        rest = np.flatnonzero(self.keys[0][s] != key)
        key = key[rest]
        s = (key * _U(self.mult[1])) >> _U(64 - self.bits)
        found = self.keys[1][s] == key
        out[rest[found]] = self.merged[1][s[found]]
        return out


def skipped(key, left, middle, right, rate: float) -> np.ndarray:
    """Whether the candidate of the symbols ``[left, middle)`` and ``[middle, right)`` of a unit is skipped."""
    places = np.asarray(left).astype(_U) * _U(0xD6E8FEB86659FD93) + np.asarray(middle).astype(_U) * _U(0xA0761D6478BD642F) \
        + np.asarray(right).astype(_U) * _U(0xE7037ED1A0B428DB)
    return mix(np.asarray(key, _U) ^ places) < _U(min(int(rate * 2.0 ** 64), 2 ** 64 - 1))


def agenda(chars: list[int], key: int, voc: Vocabulary, rate: float) -> list[tuple[int, int]]:
    """``(start, piece)`` of the symbols of one unit, by a heap of candidates."""
    n = len(chars)
    sym, end = list(chars), list(range(1, n + 1))
    prev, heap = list(range(-1, n - 1)), []

    def offer(i: int) -> None:
        j = end[i]
        if i < 0 or j >= n:
            return
        m = voc.pairs.get((sym[i], sym[j]))
        if m is not None and not (rate and bool(skipped(np.array([key], _U), [i], [j], [end[j]], rate)[0])):
            heapq.heappush(heap, (int(voc.rank[m]), i, j, end[j], m))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    while heap:
        _, i, j, e, m = heapq.heappop(heap)
        if not alive[i] or end[i] != j or not alive[j] or end[j] != e:
            continue
        sym[i], end[i], alive[j] = m, e, False
        if e < n:
            prev[e] = i
        if prev[i] >= 0:
            offer(prev[i])
        offer(i)
    return [(i, sym[i]) for i in range(n) if alive[i]]


def _short(chars: np.ndarray, key: np.ndarray, voc: Vocabulary, rate: float) -> tuple[np.ndarray, ...]:
    """Units, a column of ``chars`` each (filled up with ``_GONE``): units, starts and pieces of their symbols.

    ``best`` holds, at the start of a symbol, the rank of its candidate with the next one and the start itself, so its
    minimum is the candidate that comes first. Arrays are flat: place ``p`` of unit ``u`` is at ``p * n + u``."""
    size, n = chars.shape
    unit, out = np.arange(n), []
    sym = chars.ravel().copy()
    after = np.repeat(np.arange(1, size + 2, dtype=np.int64), n)       # start of the next symbol
    before = np.repeat(np.arange(-1, size, dtype=np.int64), n)         # of the one before
    best = np.full(size * n, _NONE, np.int32)
    joined = np.full(size * n, -1, np.int32)

    def offer(at: np.ndarray, left: np.ndarray, middle: np.ndarray, right: np.ndarray, u: np.ndarray, n: int) -> None:
        m = voc.join(sym[at], sym[middle * n + u])
        best[at], joined[at] = _NONE, m
        hit = np.flatnonzero(m >= 0)
        if rate:
            hit = hit[~skipped(key[u[hit]], left[hit], middle[hit], right[hit], rate)]
        best[at[hit]] = voc.rank[m[hit]] << 6 | left[hit].astype(np.int32)

    if size > 1:
        at = np.arange((size - 1) * n)
        left = at // n
        offer(at, left, left + 1, left + 2, at - left * n, n)
    while True:
        first = best.reshape(size, n).min(0) if n else best
        u = np.flatnonzero(first < _NONE)
        if 4 * len(u) < 3 * n or not len(u):                           # the finished units leave
            over = np.ones(n, bool)
            over[u] = False
            place, col = np.nonzero(sym.reshape(size, n)[:, over] > _GONE)
            out.append((unit[over][col], place, sym.reshape(size, n)[:, over][place, col]))
            if not len(u):
                return tuple(np.concatenate(x) for x in zip(*out))
            first, unit, key = first[u], unit[u], key[u]
            sym, best, joined = (x.reshape(size, n)[:, u].ravel() for x in (sym, best, joined))
            after, before = (x.reshape(size + 1, n)[:, u].ravel() for x in (after, before))
            n, u = len(u), np.arange(len(u))
        c = (first[u] & 63).astype(np.int64)
        at = c * n + u
        j = after[at]
        e = after[j * n + u]
        sym[at], after[at] = joined[at], e
        best[at] = _NONE
        best[j * n + u], sym[j * n + u] = _NONE, _GONE
        before[e * n + u] = c
        k = np.flatnonzero(e < size)                                   # the new symbol with the next one
        offer(at[k], c[k], e[k], after[e[k] * n + u[k]], u[k], n)
        p = before[at]
        k = np.flatnonzero(p >= 0)                                     # and with the one before
        offer(p[k] * n + u[k], p[k], c[k], e[k], u[k], n)


def encode_texts(given: list[str], keys: np.ndarray, voc: Vocabulary, rate: float) -> Iterator[np.ndarray]:
    """The ids of each text, by chunks of about ``CHUNK_CHARS`` characters (longer texts are cut between units)."""
    a = 0
    while a < len(given):
        b, size = a, 0
        while b < len(given) and size + len(given[b]) < CHUNK_CHARS:
            size += len(given[b]) + 1
            b += 1
        if b > a:
            yield from _encode([" " + t if t else "" for t in given[a:b]], keys[a:b], voc, rate)
            a = b
        else:
            yield np.concatenate([next(_encode([part], keys[a:a + 1], voc, rate, at)) for at, part in _cut(" " + given[a])])
            a += 1


def _cut(marked: str) -> Iterator[tuple[int, str]]:
    at = 0
    while at < len(marked):
        p = marked.find(" ", at + CHUNK_CHARS)
        while p > 0 and marked[p - 1] == " ":
            p = marked.find(" ", p + 1)
        end = p if p > 0 else len(marked)
        yield at, marked[at:end]
        at = end


def _encode(marked: list[str], keys: np.ndarray, voc: Vocabulary, rate: float, offset: int = 0) -> Iterator[np.ndarray]:
    """``marked``: texts with their leading space, or one part of such a text that begins at ``offset``."""
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    first = np.concatenate([[0], np.cumsum(size)])
    n = len(codes)
    if n:
        chars = voc.char[codes]
        space = codes == 32
        begin = np.append(True, space[1:] & ~space[:-1])
        begin[first[:-1][size > 0]] = True
        unit = np.flatnonzero(begin)
        length = np.diff(np.append(unit, n))
        doc = np.searchsorted(first, unit, side="right") - 1
        key = mix(keys[doc] + mix((unit - first[doc] + offset).astype(_U)))
        at = np.full(n, -2, np.int32)                     # the piece that starts at each character
        widths = [w for w in WIDTHS if w <= SHORT]
        step = np.searchsorted(widths, length)            # the width that a unit is filled up to
        for k, wide in enumerate(widths):
            group = np.flatnonzero(step == k)
            if len(group):
                place = np.arange(wide)[:, None]
                inside = place < length[group]
                given = np.where(inside, chars[np.where(inside, unit[group] + place, 0)], _GONE)
                rows, start, piece = _short(given, key[group], voc, rate)
                at[unit[group][rows] + start] = piece
        for u in np.flatnonzero(step == len(widths)):
            for start, piece in agenda(chars[unit[u]:unit[u] + length[u]].tolist(), int(key[u]), voc, rate):
                at[unit[u] + start] = piece
    for k, t in enumerate(marked):
        ids = at[first[k]:first[k + 1]] if t else np.zeros(0, np.int32)
        where = np.flatnonzero(ids != -2)
        ids = ids[where]
        odd = np.flatnonzero(ids < 0)
        if len(odd):                                      # characters without a piece: their bytes
            code = codes[first[k] + where[odd]].astype(np.int64)
            lead, count = np.array([0, 0, 0xC0, 0xE0, 0xF0]), 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
            many = np.ones(len(ids), np.int64)
            many[odd] = count
            place = (np.cumsum(many) - many)[odd]
            ids = np.repeat(ids, many)
            for b in range(4):                            # byte b of the characters that have one
                own = np.flatnonzero(count > b)
                bits = code[own] >> 6 * (count[own] - 1 - b)
                ids[place[own] + b] = voc.byte[bits | lead[count[own]] if b == 0 else bits & 0x3F | 0x80]
        yield ids.astype(np.int32)


def decode_ids(ids: np.ndarray, voc: Vocabulary) -> str:
    return b"".join(map(voc.raw.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


def encode(docs: DataFrame, model: str, seed: int = SEED, rate: float = RATE) -> DataFrame:
    """``doc_id, ids, ids_crc32`` (of the ids as little-endian uint32) of every text."""
    rows = texts(docs).select("doc_id", F.xxhash64("doc_id", F.lit(seed)).alias("key"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = Vocabulary(model)
        for b in batches:
            given = b.column(2).to_pylist()
            keys = np.asarray(b.column(1).to_numpy(zero_copy_only=False), np.int64).view(_U)
            for a in range(0, len(given), 2000):
                ids = list(encode_texts(given[a:a + 2000], keys[a:a + 2000], voc, rate))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, 2000), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids))),
                     pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())], schema=schema)

    return rows.mapInArrow(run, "doc_id long, ids array<int>, ids_crc32 long")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """All columns of ``encoded`` but ``ids``, and the ``decoded`` text (null ids: the empty text)."""
    at = encoded.columns.index("ids")
    others = [c for c in encoded.columns if c not in ("ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = Vocabulary(model)
        for b in batches:
            text = [decode_ids(x.values.to_numpy(), voc) if x.is_valid else "" for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(text, pa.string())], [*others, "decoded"])

    return encoded.mapInArrow(run, encoded.select(*others).withColumn("decoded", F.lit("")).schema)
