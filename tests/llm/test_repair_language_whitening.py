"""Conversation repair, language identification and whitening against brute force, with edge rows."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from edge_cases import DOCS, doc, edge_rows

from labelwise.llm import language, turn_repair as R, whitening as W
from labelwise.llm.common import fold, table
from labelwise.llm.queries import QUERIES
from pyspark.sql import functions as F

LARGE = "/root/testdata/sf0.1"

# ---------------------------------------------------------------- conversation repair


def cheapest(codes: str, state=R.START, ends=(R.START, R.ASSISTANT)):
    """All edit sequences of live turns, by breadth over (turn, state), without the aligned targets."""
    best = {(0, state): {(0, "")}}
    low = {}
    for k in range(len(codes) + 1):
        for _ in range(4):                                         # insertions between two turns
            for s, to in [(0, 2), (1, 2), (2, 3), (3, 2)]:
                for c, a in list(best.get((k, s), ())):
                    best.setdefault((k, to), set()).add((c + 2, a + "I"))
        if k == len(codes):
            break
        code, cut = codes[k].lower(), codes[k].isupper()
        for s in range(4):
            for c, a in best.get((k, s), ()):
                options = [(s, 3, "D")]
                for letter, to, before in (("s", 1, (0,)), ("u", 2, (0, 1, 3)), ("a", 3, (2,))):
                    if s in before and (code == letter):
                        options.append((to, cut, "K"))
                    if s in before and letter != "s":
                        options.append((to, 2 + cut, "R"))
                for to, cost, e in options:
                    best.setdefault((k + 1, to), set()).add((c + cost, a + e))
        for s in range(4):                                         # only the best three of a state can matter
            if (k + 1, s) in best:
                best[k + 1, s] = set(sorted(best[k + 1, s])[:3])
    for s in ends:
        if (len(codes), s) in best:
            low[s] = min(best[len(codes), s])
    return low


def test_alignment_is_the_cheapest_and_least():
    rng = random.Random(3)
    cases = [c for n in range(5) for c in map("".join, itertools.product("suaXU", repeat=n))]
    cases += ["".join(rng.choice("suaxSUAX") for _ in range(rng.randint(5, 14))) for _ in range(120)]
    for codes in cases:
        for state in range(4):
            want = cheapest(codes, state, range(4))
            assert R.best_audits(codes, state) == {q: b for q, b in want.items()}, (codes, state)


def test_blocks_give_the_same_as_one_table():
    rng = random.Random(4)
    for n in (1, 9, 30, 47):
        for _ in range(6):
            codes = "".join(rng.choices("suaxUA", (1, 6, 6, 1, 2, 2), k=n))
            runs = [rng.choice((0, 0, 2)) for _ in range(n + 1)]
            assert R.joined(codes, runs) == R.joined(codes, runs, direct=4, block=3), codes


def brute_repair(rows):
    """``rows``: conv_id, turn, role, text. The summary and digest of each conversation, with plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r").lstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        codes, runs, live = "", [0], []
        for (_, role, text), f in zip(own, faults):
            if f in ("b", "d") and f:
                runs[-1] += 1
            else:
                code = role[:1] if role[:1] in ("s", "u", "a") else "x"
                codes += code.upper() if f == "t" else code
                runs.append(0)
                live.append((role, text))
        cost, audit = min(cheapest(codes).values())
        lines, state = [], 0
        k = 0
        for e in audit:
            if e != "D":
                letter = "s" if e == "K" and codes[k].lower() == "s" else "a" if state == 2 else "u"
                state = {"s": 1, "u": 2, "a": 3}[letter]
                role = live[k][0] if e == "K" else {"u": "user", "a": "assistant"}[letter]
                lines.append(f"{role}:{'' if e == 'I' else live[k][1]}")
            k += e != "I"
        turns = {r[0] for r in own} - {None}
        two = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
                     sum(t not in ("su", "ua", "au") for t in two), cost + 3 * sum(runs), R.weave(audit, runs),
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


TURNS = "conv_id long, turn long, role string, text string, kind string, live string, n string"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def turn_rows():
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "USER"], ["a.", "b", "c! ", "", " \t", None, "long " * 2000, "é? "]
    rows = [(c, rng.choice([None, 0, 1, 1, 2, 5, 9, -3]), rng.choices(roles, (6, 6, 2, 1, 1, 1, 1))[0], rng.choice(texts))
            for c in [None, 1, 2, 3] for _ in range(9)]
    rows += [(7, t, "user" if t % 2 else "assistant", f"turn {t}" + "." * (t % 3)) for t in range(700) if t % 11]
    rows += [(8, t, "user", "same text.") for t in range(300)] + [(9, 4, "user", "x.")] * 5 + [(10, None, None, None)]
    rows += [(11, -(1 << 62), "user", "x."), (11, 1 << 62, "assistant", "x.")]
    return [r + ("clash",) * 3 for r in rows]


def test_repair_matches_brute_force_over_range_edges(spark):
    rows = turn_rows()
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    want = brute_repair([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x, *_ in rows])
    for parts in ("1", "6"):                       # six ranges: long conversations go on over several
        old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
        try:
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in R.with_digests(df, df).collect()}
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)
        assert got == want


def test_repair_keeps_conversations_without_turns(spark):
    none = spark.createDataFrame([], TURNS)
    assert R.with_digests(none, none).count() == 0
    some = spark.createDataFrame(turn_rows()[-1:], TURNS)
    assert [tuple(r) for r in R.with_digests(none, some).collect()] == [(11, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_damage(spark):
    rows = turn_rows()
    df = spark.createDataFrame(rows, TURNS)
    want = Counter()
    for c, t, role, text, *_ in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = ("user" if k == 4 else " " if role is None else role), " " if text is None else text
        text = "" if k == 1 else text.translate({ord(x): None for x in ".!?"}) if k == 2 else text
        want[c, t, role, text] += 0 if k == 0 else 2 if k == 3 else 1
    assert Counter(tuple(r) for r in R.damage(df).collect()) == +want


# ---------------------------------------------------------------- language identification


def brute_grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    out = Counter()
    for w in words:
        out.update(w)
    line = " " + " ".join(words) + " " if words else ""
    out.update(line[i:i + 2] for i in range(len(line) - 1))
    out.update(line[i:i + 3] for i in range(len(line) - 2) if line[i + 1] != " ")
    return out


def order_key(gram):
    key = 0
    for c in gram:
        key = key << 21 | (1 if c == " " else ord(c))
    return key


def brute_languages(rows, learn, size):
    counts = {}
    for i, text, lang in rows:
        if i is not None and lang is not None and text is not None and learn(i):
            counts.setdefault(lang, Counter()).update(brute_grams(text))
    profiles = {lang: {g: k for k, g in enumerate(sorted(c, key=lambda g: (-c[g], order_key(g)))[:size])} for lang, c in counts.items() if c}
    out = []
    for i, text, _ in rows:
        own = brute_grams(text)
        top = sorted(own, key=lambda g: (-own[g], order_key(g)))[:size]
        if not top or not profiles:
            out.append((i, "und", 0.0))
            continue
        at = {}
        for n in {own[g] for g in top}:
            same = [k for k, g in enumerate(top) if own[g] == n]
            at[n] = (same[0] + same[-1]) / 2
        d = sorted((np.mean([abs(p[g] - at[own[g]]) if g in p else size for g in top]), lang) for lang, p in profiles.items())
        second = d[1][0] if len(d) > 1 else size
        out.append((i, d[0][1], round(1 - d[0][0] / second if second > 0 else 0.0, 9)))
    return out


def language_rows():
    rng = random.Random(6)
    sounds = {"en": "the ing and of tion that", "fr": "que ment eau les dé ç", "日": "日 本 語 の は", "": "q w x z"}
    rows = [(k, "".join(rng.choice(s.split()) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(1, 60))), lang)
            for k, (lang, s) in enumerate(itertools.chain.from_iterable([sounds.items()] * 12))]
    rows += [(r[0], r[1], r[2]) for r in edge_rows()] + [(900, "123 ...", "en"), (901, "a", None), (902, None, "xx"), (903, "İ퟿ß " * 3, "tr")]
    return rows


@pytest.mark.parametrize("size,slice_", [(400, 1024), (7, 2)])
def test_language_matches_brute_force(spark, monkeypatch, size, slice_):
    monkeypatch.setattr(language, "SLICE", slice_)
    rows = language_rows()
    df = spark.createDataFrame([r + ("clash", "clash") for r in rows], "doc_id long, text string, lang string, best_lang string, gram string").repartition(3)
    model = language.fit(df, lambda c: fold(c, 4) != 2, size)
    got = language.predict(df, model, "predicted", "sure")
    assert got.columns == df.columns + ["predicted", "sure"]
    want = brute_languages(rows, lambda i: zlib.crc32(str(i).encode()) % 4 != 2, size)
    assert Counter((r.doc_id, r.predicted, round(r.sure, 9)) for r in got.collect()) == Counter(want)


def test_long_texts_are_counted_by_parts():
    text = "the cats, of 日本 and l'été " * 300
    for part in (5, 64, 1000):
        a, b = language.grams(text, part), language.grams(text)
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    assert dict(zip(*(x.tolist() for x in language.grams(text)))) == {order_key(g): n for g, n in brute_grams(text).items()}


def test_language_without_teachers(spark):
    empty = spark.createDataFrame([], DOCS)
    assert language.predict(empty, language.fit(empty), "p", "s").count() == 0
    some = spark.createDataFrame([doc(1, "text"), doc(None, None)], DOCS)
    got = language.predict(some, language.fit(empty), "p", "s").collect()
    assert {(r.p, r.s) for r in got} == {("und", 0.0)}


def test_held_out_languages(spark):
    got = QUERIES["op12_language_id"](spark, LARGE).where("held_out").join(table(spark, LARGE, "documents").select("doc_id", "lang"), "doc_id")
    right = {r.lang: r.a for r in got.groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a")).collect()}
    assert len(right) == 4 and min(right.values()) >= 0.99, right


# ---------------------------------------------------------------- whitening

VECTORS = "vec_id long, embedding array<float>, x string, component string"


def test_rank_one_updates():
    rng = np.random.default_rng(1)
    for d in (1, 2, 7, 33):
        values, vectors, scatter = np.zeros(d), np.eye(d), np.zeros((d, d))
        for k in range(3 * d):
            v = [rng.integers(-3, 4, d).astype(float), rng.normal(size=d) * 1e-6, np.eye(d)[k % d], np.ones(d), np.zeros(d)][k % 5]
            values, vectors = W.update(values, vectors, v)
            scatter += np.outer(v, v)
            assert (np.diff(values) >= 0).all()
        top = values.max()
        assert np.abs(values - np.linalg.eigvalsh(scatter)).max() <= 1e-13 * top
        assert np.abs(vectors * values @ vectors.T - scatter).max() <= 1e-13 * top
        assert np.abs(vectors.T @ vectors - np.eye(d)).max() <= 1e-12


def test_spectra_combine_in_any_order():
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (900, 6)).astype(float)
    parts = [W.add_block(W.Spectrum.empty(6), W.Block.of(p)) for p in np.split(x, [3, 10, 400])]
    whole = W.combine(W.combine(parts[3], parts[0]), W.combine(parts[1], parts[2]))
    centred = x - x.mean(axis=0)
    assert whole.n == 900 and np.allclose(whole.mean, x.mean(axis=0))
    assert np.allclose(whole.vectors * whole.values @ whole.vectors.T, centred.T @ centred, rtol=1e-12, atol=1e-7)


def check_whitening(spark, rows, tolerance=1e-9):
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = sorted(W.whiten(df).collect(), key=lambda r: (r.vec_id is None, r.vec_id or 0, r.deviation or 0, r.component))
    kept = [(i, [int(np.floor(256.0 * float(np.float32(c)))) for c in v]) for i, v, *_ in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max((len(v) for _, v in kept), default=0)
    kept = [(i, v + [0] * (d - len(v))) for i, v in kept]
    fit = np.array(sorted({tuple(v) for _, v in kept}), dtype=float).reshape(-1, d)
    n, mean = len(fit), fit.mean(axis=0)
    cov = (fit - mean).T @ (fit - mean) / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    k = int((values[:4] > 1e-12 * values.sum()).sum())
    assert len(got) == len(kept) * k
    sums = [sum(int(v) for v in col) for col in fit.T.astype(int)]
    want = Counter((i, c + 1, n, sum((n * e - s) ** 2 for e, s in zip(v, sums))) for i, v in kept for c in range(k))
    assert Counter((r.vec_id, r.component, r.n, r.deviation) for r in got) == want
    for c in range(k):
        mine = sorted((r.deviation, r.whitened) for r in got if r.component == c + 1)
        theirs = sorted((sum((n * e - s) ** 2 for e, s in zip(v, sums)), (np.array(v) - mean) @ basis[:, c] / np.sqrt(values[c])) for _, v in kept)
        gap = min([abs(values[c] - values[o]) for o in range(d) if o != c], default=1.0)
        if gap > 1e-6 * values[0]:
            a, b = (np.array([w for _, w in rows]) for rows in (mine, theirs))
            assert np.allclose(np.sort(np.abs(a)), np.sort(np.abs(b)), atol=tolerance), c
    assert all(abs(r.explained - values[r.component - 1] / values.sum()) < 1e-12 and r.identity_error < 1e-9 for r in got)


def vector_rows(n=300, d=6, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ np.diag(np.linspace(1, 0.2, d))
    return [(k, [float(c) for c in v], "clash", "clash") for k, v in enumerate(x)]


def test_whitening_matches_eigh(spark):
    rows = vector_rows()
    copies = [(1000 + k, rows[5][1], "clash", "clash") for k in range(200)]       # a hot vector counts once
    odd = [(None, rows[7][1], "c", "c"), (2000, None, "c", "c"), (2001, [1.0, None], "c", "c"), (2002, [float("nan")] * 6, "c", "c"),
           (2003, [float("inf")] * 6, "c", "c"), (3, rows[3][1], "c", "c"), (2004, [], "c", "c"), (2005, [0.5, -0.25], "c", "c")]
    check_whitening(spark, rows + copies + odd)


def test_whitening_of_few_or_flat_vectors(spark):
    check_whitening(spark, [(1, [0.5, 1.0, 0.0], "c", "c"), (2, [0.0, 1.0, 0.0], "c", "c")])     # one component has a variance
    check_whitening(spark, vector_rows(9, 2))
    for rows in ([], [(1, None, "c", "c")], [(1, [1.0], "c", "c")] * 3, [(1, [], "c", "c"), (2, [], "c", "c")]):
        got = W.whiten(spark.createDataFrame(rows, VECTORS))
        assert got.count() == 0 and got.columns == [f.split()[0] for f in W.FIELDS.split(", ")]


def test_large_entries_keep_exact_deviations():
    x = np.array([[1 << 40, -5], [3, 1 << 41], [7, 7]])
    f = W.Fit(3, W._exact_sums(x), np.ones(2), np.eye(2), 2.0)
    assert f.sums == [sum(int(v) for v in c) for c in x.T]
    assert f.deviations(x) == [None if (v := sum((3 * int(c) - s) ** 2 for c, s in zip(r, f.sums))) >= 1 << 63 else v for r in x]
    assert np.allclose(f.centred(x), (x - x.mean(axis=0)), rtol=1e-12)


def test_many_partitions_are_combined_in_a_tree(spark):
    rows = vector_rows(400, 5, 9)
    df = spark.createDataFrame(rows, VECTORS)
    x = W.integer_vectors(df).select("x").distinct().repartition(40)
    spectra = W._spectra(x, 5)
    total, sums = W._combined(spectra, 40, 5)
    assert total.n == 400 and sums == [int(s) for s in np.floor(256 * np.array([r[1] for r in rows], np.float32).astype(float)).sum(axis=0)]
