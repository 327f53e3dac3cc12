"""Fingerprints, encoding, packing and the three duplicate operators against brute force, with edge rows."""

import hashlib
import os
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from edge_cases import DOCS, doc, edge_rows, passage

from labelwise.llm import fingerprints, merge_dropout, near_duplicates, packing, substring, suffixes
from labelwise.llm.common import SpanHash, hashed_words, sliding_argmin, utf8, word_spans
from labelwise.llm.components import components
from labelwise.llm.settings import tokenizer
from labelwise.llm.shared_runs import CELL, Cells

RANKS, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
ROWS = [(r[0], r[1] or "") for r in edge_rows()]


def words(text):
    return [w.decode() for w in text.encode().split()]


# ---------------------------------------------------------------- helpers

def test_words_are_runs_without_ascii_space():
    texts = ["", "a b", "\x1cq\x85 é", " \x0b\x0cx", None, "y" * 10]
    data, off = utf8(pa.array(texts))
    s, e, woff = word_spans(data, off)
    got = [[bytes(data[a:b]).decode() for a, b in zip(s[i:j], e[i:j])] for i, j in zip(woff, woff[1:])]
    assert got == [words(t or "") for t in texts]


def test_word_hashes_do_not_depend_on_the_place():
    texts = ["a bb a", "bb", passage(1, 500) + " a"]
    ((_, _, h, off),) = hashed_words(pa.array(texts))
    assert h[0] == h[2] == h[-1] and h[1] == h[off[1]] and len(set(h.tolist())) == len(set(" ".join(texts).split()))


def test_components(spark):
    edges = [(5, 3), (3, 9), (9, 11), (20, 21), (7, 7), (None, 3), (3, 5)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {5: 3, 9: 3, 11: 3, 21: 20, **{101 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n)), "".join("ba"[bin(i).count("1") % 2] for i in range(n))


def test_hashes_tell_structured_words_and_spans_apart():
    """Strings on which polynomials modulo a power of two collide."""
    for n in (1024, 4096):
        one, two = thue_morse(n)
        ((_, _, h, _),) = hashed_words(pa.array([f"{one} {two}"]), wide=True)
        assert (h[:, 0] != h[:, 1]).all()
        words_ = np.array([[11, 12][c == "b"] for c in one + two], np.uint64)
        for seed in (0, 1):
            span = SpanHash(words_, seed)
            assert span(np.array([0]), n) != span(np.array([n]), n)


def test_span_hashes_are_those_of_the_words():
    rng = np.random.default_rng(4)
    words_ = rng.integers(0, 3, 400).astype(np.uint64)
    for seed in (0, 1):
        span, seen = SpanHash(words_, seed), {}
        start = rng.integers(0, 300, 3000)
        length = rng.integers(1, 100, 3000)
        for s, n, h in zip(start, length, span(start, length).tolist()):
            assert seen.setdefault(h, words_[s:s + n].tobytes()) == words_[s:s + n].tobytes()
            assert span(np.array([s]), int(n))[0] == h
    assert len(span(np.zeros(0, np.int64), 5)) == 0


def test_structured_words_are_neither_removed_nor_linked(spark):
    one, two = thue_morse(1024)
    a = " ".join([passage(1, 30), one, passage(2, 30)])
    b = " ".join([passage(1, 30), two, passage(2, 30)])
    docs = spark.createDataFrame([doc(1, a), doc(2, b), doc(3, a.replace("w", "v")), doc(4, one), doc(5, two)], DOCS)
    assert {r.doc_id: r.n_removed for r in substring.dedup(docs).collect()} == dict.fromkeys(range(1, 6), 0)
    assert suffixes.duplicate_spans(docs).count() == 0
    assert near_duplicates.keep_one(docs).where("doc_id in (4, 5)").count() == 2


def test_short_notes_are_told_apart():
    """Two notes whose shingles agree in 40 bits of the hash that was kept before."""
    notes = [f"note {i}" for i in (834861, 2600719)] + [f"note {i}" for i in range(2000)]
    sets = []
    for _, _, h, woff in hashed_words(pa.array(notes)):
        items, off = near_duplicates.shingle_sets(h, woff)
        sets += items.tolist()
    assert len(set(sets)) == len(notes) and max(sets) >> 40
    exact = near_duplicates.exact_sets(notes + [passage(1, 9), passage(1, 8), "", notes[0]])
    assert len({int(e[0]) for e in exact[:len(notes)]}) == len(notes) and (exact[-1] == exact[0]).all() and not len(exact[-2])
    assert len(np.intersect1d(exact[-4], exact[-3])) == 4


# ---------------------------------------------------------------- 1 fingerprints

def test_prefix_arrays_against_plain_strings():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abé"), n)) for n in (0, 1, 5, 40, 300)]
    p = fingerprints.PrefixArrays(texts)
    for _ in range(300):
        a, b = rng.integers(0, 5, 2)
        i, j = int(rng.integers(0, len(texts[a]) + 1)), int(rng.integers(0, len(texts[b]) + 1))
        n = int(rng.integers(0, min(len(texts[a]) - i, len(texts[b]) - j) + 1))
        one = [np.array([x]) for x in (a, i, b, j)]
        assert p.equal(*one, n)[0] == (texts[a][i:i + n] == texts[b][j:j + n])
        assert p.extension(*one)[0] == len(os.path.commonprefix([texts[a][i:], texts[b][j:]]))


@pytest.mark.parametrize("parts", ["2", "7"])
def test_fingerprints(spark, edge, no_docs, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = fingerprints.fingerprints(edge).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = sorted(ROWS, key=lambda r: (-(r[0] if r[0] is not None else -1), r[1]))
    want = Counter()
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        e = fingerprints.edited_text(t, following)
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), len(os.path.commonprefix([t, e]))] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.common_prefix) for r in got) == want
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    by_id = {r.doc_id: r for r in got}
    assert by_id[5].fingerprint == by_id[6].fingerprint != by_id[7].fingerprint
    assert by_id[12].near_edited > 0.3 > by_id[12].near_next and by_id[6].near_next == 1
    assert fingerprints.fingerprints(no_docs).count() == 0


# ---------------------------------------------------------------- 2 merge dropout

ODD = ["", "a", " ", "  a   b", "▁x ▁", "日本語", "😀 a\nb\t\tc", "a" * 200 + " " + "ab" * 60, "xé́ß " + "   " * 30 + "z", "\x00 q"]


def test_encoding_without_dropout_is_the_library_s():
    import sentencepiece

    voc = merge_dropout.Vocabulary(tokenizer(PIECES))
    texts = [t for t in ODD if "▁" not in t] + [passage(3, 300), "The quick brown fox, jumps over."]
    got = merge_dropout.encode_texts(texts, np.arange(len(texts), dtype=np.uint64), voc, 0.0)
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECES))
    assert [x.tolist() for x in got] == lib.encode(texts)


def test_rounds_heap_and_parts_agree(monkeypatch):
    voc = merge_dropout.Vocabulary(tokenizer(PIECES))
    texts, keys = ODD + [passage(5, 400)], np.arange(len(ODD) + 1, dtype=np.uint64)
    want = [x.tolist() for x in merge_dropout.encode_texts(texts, keys, voc, 0.3)]
    monkeypatch.setattr(merge_dropout, "SHORT", 0)
    assert [x.tolist() for x in merge_dropout.encode_texts(texts, keys, voc, 0.3)] == want
    monkeypatch.setattr(merge_dropout, "CHUNK_CHARS", 40)
    assert [x.tolist() for x in merge_dropout.encode_texts(texts, keys, voc, 0.3)] == want
    assert [merge_dropout.decode_ids(np.array(x, int), voc) for x in want] == texts


def test_encode_decode(spark, edge, no_docs):
    model = tokenizer(PIECES)
    encoded = merge_dropout.encode(edge, model)
    assert Counter((r.doc_id, r.decoded) for r in merge_dropout.decode(encoded, model).collect()) == Counter(ROWS)
    one, two, plain = (sum(r.n for r in merge_dropout.encode(edge, model, **k).selectExpr("size(ids) n").collect())
                       for k in ({"seed": 1}, {"seed": 2}, {"rate": 0.0}))
    assert plain < min(one, two) and one != two
    assert merge_dropout.decode(merge_dropout.encode(no_docs, model), model).count() == 0


# ---------------------------------------------------------------- 3 packing

def test_ids_are_those_of_the_json_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    mark = packing.ADDED
    texts = ODD + [passage(3, 500), f"don't  stop\n\n now {mark} 12345", " a \n b  c", mark, f"{mark} hello", f"hello {mark}",
                   mark * 3, f"{mark}\n {mark}  {mark}x", f"{mark[:-1]} {mark[1:]}", f"words {mark} " * 40, ("x" * 19 + mark) * 9 + " y"]
    assert np.frombuffer(packing.Encoder(tokenizer(RANKS)).ids(f"{mark} hello"), "<u4").tolist() == [50256, 23748]
    enc = packing.Encoder(tokenizer(RANKS))
    for size in (1 << 20, 20):
        monkeypatch.setattr(packing, "SEGMENT_CHARS", size)
        for t in texts:
            assert np.frombuffer(enc.ids(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def best_fit_decreasing(sizes, room):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(room - s)
    return len(gaps)


def test_plan_is_a_packing_about_as_good_as_best_fit():
    rng = np.random.default_rng(3)
    for room in (16, 100):
        sizes = rng.integers(1, room + 1, 400).tolist()
        runs = packing.sweep_plan(Counter(sizes), room)
        bins, used = defaultdict(list), Counter()
        for size, rank, n, first, offset in runs.tolist():
            for k in range(n):
                bins[first + k].append((offset, size))
            used[size] += n
        assert used == Counter(sizes)
        for b in bins.values():
            at = 0
            for offset, size in sorted(b):
                assert offset == at
                at += size
            assert at <= room
        assert len(bins) <= 1.03 * best_fit_decreasing(sizes, room) + 1


def check_packing(rows, docs, room):
    seqs, ids = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        ids[r.doc_id].append((r.piece, r.start, r.length))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= room
    enc = packing.Encoder(tokenizer(RANKS))
    want = Counter()
    for i, t in docs:
        want.update((i, k, s, n) for k, (s, n) in enumerate(packing.cut(len(enc.ids(t)) // 4 + 1, room)))
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in rows) == want


def test_pack(spark, edge, no_docs):
    check_packing(packing.pack(edge, tokenizer(RANKS)).collect(), ROWS, 2048)
    assert packing.pack(no_docs, tokenizer(RANKS)).count() == 0


# ---------------------------------------------------------------- 4 substring dedup

def removed(docs, window=50):
    """Brute force: for each row the words that stay."""
    first = {}
    for i, t in docs:
        if i is not None:
            w = words(t)
            for k in range(len(w) - window + 1):
                key = tuple(w[k:k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in docs:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        out.append([x for k, x in enumerate(w) if k not in gone])
    return out


def random_docs(n, seed):
    """Texts made of a few blocks, so that passages of all lengths repeat at any place, also inside a text."""
    rng = np.random.default_rng(seed)
    blocks = [passage(int(s), int(k)) for s, k in zip(rng.integers(0, 50, 12), rng.integers(5, 130, 12))] + ["x y " * 60]
    return [(int(i), " ".join(blocks[b] for b in rng.integers(0, len(blocks), rng.integers(1, 7)))) for i in rng.integers(0, n, n)]


@pytest.mark.parametrize("docs", [ROWS, random_docs(60, 1), random_docs(60, 2)], ids=["edge", "random1", "random2"])
def test_substring_dedup(spark, docs):
    given = spark.createDataFrame([doc(i, t) for i, t in docs], DOCS)
    want = removed(docs)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(given).collect())
    assert got == Counter((i, len(words(t)), len(words(t)) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest())
                          for (i, t), k in zip(docs, want))
    cleaned = substring.clean(given)
    assert cleaned.columns == given.columns and cleaned.schema["n_chars"].dataType == given.schema["n_chars"].dataType
    assert Counter((r.doc_id, r.text or "") for r in cleaned.collect()) == Counter(
        (i, t if len(k) == len(words(t)) else " ".join(k)) for (i, t), k in zip(docs, want))


def test_substring_dedup_of_nothing(no_docs):
    assert substring.dedup(no_docs).count() == 0 and substring.clean(no_docs).columns == no_docs.columns


def near_copies(n, seed, length=400):
    """Copies of one text, some words apart from each other changed in each, with a line and a passage of many others around them."""
    rng = np.random.default_rng(seed)
    base, shared, out = passage(7, length).split(), passage(8, 90), []
    for i in range(n):
        w = list(base)
        for k in rng.choice(length, length // 75, replace=False):
            w[k] = f"edit{i}x{k}"
        own = passage(1000 + i, int(rng.integers(0, 70)))
        out.append((i, " ".join([own, *w[int(rng.integers(0, 60)):], passage(2000 + i, int(rng.integers(0, 9))), shared, own[::-1]])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_of_near_copies(spark, seed):
    docs = near_copies(60, seed)
    got = {r.doc_id: r.kept_sha256 for r in substring.dedup(spark.createDataFrame([doc(i, t) for i, t in docs], DOCS)).collect()}
    assert got == {i: hashlib.sha256(" ".join(k).encode()).hexdigest() for (i, _), k in zip(docs, removed(docs))}


def test_repeated_passages_of_near_copies_make_few_spans(spark):
    """Spans of neighbouring windows and repeats inside a text, not a row for each window."""
    docs = near_copies(60, 3) + [(100 + i, " ".join([passage(3000 + i, 9), (passage(9, 11) + " ") * (20 + i), passage(4000 + i, 9)])) for i in range(20)]
    *_, spans = substring.duplicate_spans(spark.createDataFrame([doc(i, t) for i, t in docs], DOCS))
    rows = spans.collect()
    want, first = set(), {}
    for i, t in docs:
        w = words(t)
        want |= {(i, k) for k in range(len(w) - 49) if first.setdefault(tuple(w[k:k + 50]), i) < i}
    got = {(r.doc_id, k) for r in rows for x in r.places for k in range(x, x + r.n)}
    assert got == want and len(rows) * 4 < len(want)


def test_cells_follow_from_their_windows():
    """Equal windows have equal cores and places in their cells, whatever is around them, also where grams repeat."""
    texts = [" ".join(x) for x in ((passage(1, 30), passage(2, 150)), (passage(3, 41), passage(2, 150), passage(4, 9)),
                                   (passage(5, 3), "a b " * 90), ("c " + "a b " * 80, passage(6, 20)), (passage(2, 150),))]
    ((_, _, words_, woff),) = hashed_words(pa.array(texts), wide=True)
    size = np.diff(woff) - 49
    where = np.repeat(np.arange(len(texts)), size)
    at = np.concatenate([woff[k] + np.arange(n) for k, n in enumerate(size)])
    span = SpanHash(words_[0])
    c = Cells(span, woff, where, at)
    core = np.repeat(span(c.core, 50 - CELL + 1), np.diff(c.begin))
    place = np.repeat(c.core, np.diff(c.begin)) - at
    found = defaultdict(set)
    for k, h in enumerate(span(at, 50)):
        found[h].add((core[k], place[k]))
    assert all(len(x) == 1 for x in found.values()) and place.min() >= 0 and place.max() < CELL
    first, last = (np.repeat(woff[c.doc] + x, np.diff(c.begin)) for x in (c.first, c.last))
    assert (first <= at).all() and (at <= last).all() and (first >= woff[where]).all() and (last + 50 <= woff[where + 1]).all()


def test_places_of_the_least():
    x = np.random.default_rng(1).integers(0, 5, 200)
    for width in (1, 2, 7, 43, 200, 201):
        assert sliding_argmin(x, width).tolist() == [k + int(np.argmin(x[k:k + width])) for k in range(200 - width + 1)]


# ---------------------------------------------------------------- 8 suffixes

def covered(docs, window=50):
    have = defaultdict(set)
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - window + 1):
            have[tuple(w[k:k + window])].add(i)
    out = defaultdict(set)
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - window + 1):
            if i is not None and len(have[tuple(w[k:k + window])] - {None}) > 1:
                out[i].update(range(k, k + window))
    return {i: c for i, c in out.items() if c}


def test_suffix_spans(spark, edge, no_docs):
    got = defaultdict(set)
    for r in suffixes.duplicate_spans(edge).collect():
        assert r.n_words >= 50 and r.earlier == (r.other_doc_id < r.doc_id)
        got[r.doc_id].update(range(r.first_word, r.first_word + r.n_words))
    assert got == covered(ROWS)
    assert suffixes.duplicate_spans(no_docs).count() == 0


def test_suffix_spans_of_random_texts(spark):
    docs = [(i, t) for i, (_, t) in enumerate(random_docs(50, 3))]
    got = defaultdict(set)
    for r in suffixes.duplicate_spans(spark.createDataFrame([doc(i, t) for i, t in docs], DOCS).repartition(5)).collect():
        got[r.doc_id].update(range(r.first_word, r.first_word + r.n_words))
    want = covered(docs)
    assert all(got[i] <= want.get(i, set()) for i in got)                   # nothing that is not repeated
    assert sum(len(got[i] & want[i]) for i in want) >= 0.97 * sum(map(len, want.values()))


def smallest_others(docs, window=50):
    """For each repeated word of each document the smallest other document that has a window over it."""
    have = defaultdict(set)
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - window + 1):
            have[tuple(w[k:k + window])].add(i)
    out = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - window + 1):
            others = have[tuple(w[k:k + window])] - {i}
            for x in range(k, k + window) if others else ():
                out[i, x] = min(out.get((i, x), min(others)), min(others))
    return out


def check_spans(spark, docs):
    want, seen = smallest_others(docs), set()
    for r in suffixes.duplicate_spans(spark.createDataFrame([doc(i, t) for i, t in docs], DOCS).repartition(5)).collect():
        at = [(r.doc_id, x) for x in range(r.first_word, r.first_word + r.n_words)]
        assert r.other_doc_id == min(want[x] for x in at) and r.earlier == (r.other_doc_id < r.doc_id)
        seen.update(at)
    assert seen == set(want)


def test_smallest_document_of_a_passage_in_many(spark):
    shared, order = passage(900, 60), np.random.default_rng(2).permutation(300).tolist()
    docs = [(i, f"{passage(1000 + i, 30)} {shared} {passage(2000 + i, 30)}") for i in order]
    check_spans(spark, docs + [(400 + i, docs[7][1]) for i in range(5)])


def test_passages_before_a_line_in_many_documents(spark):
    line, order = passage(901, 20), np.random.default_rng(3).permutation(400).tolist()
    before = [passage(3000 + k, 40) if k < 40 else passage(4000 + i, 40) for i, k in enumerate(np.arange(400) // 2)]
    docs = [(i, f"{passage(5000 + i, 20)} {before[k]} {line} {passage(6000 + i, 30)}") for k, i in enumerate(order)]
    assert len({i for i, _ in smallest_others(docs)}) == 80
    check_spans(spark, docs)


# ---------------------------------------------------------------- 10 near duplicates

def linked(docs):
    """Brute force: links of each row, and its component's smallest id."""
    sets = []
    for _, t in docs:
        w = words(t)
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    n, parent = len(docs), list(range(len(docs)))
    links = [0] * n

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(n):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a], links[b] = links[a] + 1, links[b] + 1
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(docs):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return Counter((i, least.get(find(a)) if sets[a] else i, links[a]) for a, (i, _) in enumerate(docs))


def near_group(n, seed):
    """Near copies of one text, copies of them and other texts."""
    rng = np.random.default_rng(seed)
    base = passage(seed, 160).split()
    out = []
    for i in range(n):
        w = list(base)
        for k in rng.integers(0, 160, rng.integers(0, 4)):
            w[k] = f"new{rng.integers(0, 5)}"
        out.append((i, " ".join(w)))
    return out + [(n + i, out[i][1]) for i in range(n // 4)] + [(2 * n + i, passage(1000 + i, 50)) for i in range(5)]


@pytest.mark.parametrize("docs", [ROWS, near_group(40, 5)], ids=["edge", "group"])
@pytest.mark.parametrize("block,shingles", [(near_duplicates.BLOCK, near_duplicates.BLOCK_SHINGLES), (7, 10**6), (1, 50)])
def test_near_duplicates(spark, docs, block, shingles, monkeypatch):
    """Also with blocks so small that many are empty."""
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    monkeypatch.setattr(near_duplicates, "BLOCK_SHINGLES", shingles)
    given = spark.createDataFrame([doc(i, t) for i, t in docs], DOCS).repartition(3)
    got = near_duplicates.near_duplicates(given).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == linked(docs)


def test_keep_one(spark, edge, no_docs):
    kept = near_duplicates.keep_one(edge)
    assert kept.columns == edge.columns
    rows = kept.collect()
    assert Counter((r.doc_id, r.text or "") for r in rows) == Counter(
        [(i, t) for i, t in ROWS if i not in (4, 6, 7)] + [(4, "one two")])
    assert near_duplicates.keep_one(no_docs).count() == 0


def test_narrow_ids(spark):
    """Ids of a narrower integer type."""
    docs = spark.createDataFrame([(1, passage(1, 60)), (2, passage(1, 60)), (3, None)], "doc_id int, text string")
    assert fingerprints.fingerprints(docs).count() == packing.pack(docs, tokenizer(RANKS)).count() == 3
    assert {r.doc_id: r.n_removed for r in substring.dedup(docs).collect()} == {1: 0, 2: 60, 3: 0}
    assert substring.clean(docs).schema["doc_id"].dataType == near_duplicates.keep_one(docs).schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert near_duplicates.keep_one(docs).count() == 2 and suffixes.duplicate_spans(docs).count() == 2


def test_prefix_depth_reaches_the_recall():
    d = near_duplicates.prefix_depth(0.8)
    assert 1 - (1 - 0.8 ** d) ** near_duplicates.TREES >= near_duplicates.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** near_duplicates.TREES


def test_recall_just_over_the_threshold(spark):
    """Pairs at likeness 0.80 to 0.86, all compared by brute force: at least 0.9 of their links are found (0.99 is planned)."""
    rng, docs = np.random.default_rng(8), []
    for k in range(250):
        w = passage(10000 + k, int(rng.integers(60, 200))).split()
        changed = list(w)
        n = len(w) - 4
        for j in range(max(1, round(0.1 * n / 5 * float(rng.uniform(0.72, 0.98))))):
            changed[(j * 11 + 5) % len(w)] = f"other{k}x{j}"
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(changed))]
    wanted = set()
    for (i, a), (_, b) in zip(docs[::2], docs[1::2]):
        x, y = ({tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in (a.split(), b.split()))
        likeness = len(x & y) / len(x | y)
        if 0.8 <= likeness <= 0.86:
            wanted.add(i)
    assert len(wanted) >= 60
    got = near_duplicates.near_duplicates(spark.createDataFrame([doc(i, t) for i, t in docs], DOCS).repartition(4)).collect()
    found = {r.doc_id for r in got if r.doc_id in wanted and r.n_links}
    assert len(found) >= 0.9 * len(wanted), (len(found), len(wanted))
