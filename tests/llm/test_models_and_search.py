"""Classifiers on held-out rows, preference formatting, top-k search, the pipeline and its edge rows."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from edge_cases import edge_rows

import corpus_pipeline
from labelwise.llm import mtree, preferences, quality, toxicity
from labelwise.llm.common import fold, hashed_words, table
from labelwise.llm.queries import ORACLE, QUERIES
from labelwise.llm.settings import quality_model, toxicity_model
from oracle_harness import compare, duck
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    r = compare(spark, name, QUERIES[name], ORACLE[name], SF, duck(SF))
    assert r["match"], r


def test_folds_are_crc32(spark):
    got = spark.range(200).select("id", fold("id", 3).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 3 for r in got)


@pytest.mark.parametrize("op,label,threshold,least", [("op5_toxicity", "toxic", 0.7, 0.95), ("op7_quality_classifier", "quality", 0.3, 0.97)])
def test_held_out_accuracy(spark, op, label, threshold, least):
    got = QUERIES[op](spark, LARGE).join(table(spark, LARGE, "labels"), "doc_id").where("held_out").toPandas()
    assert ((got.score >= threshold).astype(int) == got.predicted).all() and got.score.between(0, 1).all()
    assert (got.predicted == got[label]).mean() >= least
    assert (got.predicted == got[label])[got[label] == (label == "quality")].mean() >= (0.99 if label == "quality" else 0.7)


@pytest.mark.parametrize("fit,score,model", [(quality.fit, quality.score, quality_model), (toxicity.fit, toxicity.score, toxicity_model)])
def test_classifiers_on_edge_rows(spark, edge, no_docs, fit, score, model):
    labels = spark.createDataFrame([(i, int(i % 2), int(i > 9)) for i in range(4, 14)] + [(None, 1, 1), (99, None, None)],
                                   "doc_id long, quality int, toxic int")
    for label in ("quality", "toxic"):
        m = fit(edge, labels, label)
        got = score(edge, m, "out")
        assert got.columns == [*edge.columns, "out"]
        rows = got.collect()
        assert len(rows) == len(edge_rows()) and all(0 <= r.out <= 1 for r in rows)
        same = {r.doc_id: r.out for r in rows}
        assert same[5] == pytest.approx(same[6]) and same[1] == pytest.approx(same[2])
        assert score(no_docs, m, "out").count() == 0
        none = fit(edge, labels.where("false"), label)
        assert score(edge, none, "out").count() == len(edge_rows())
        assert score(no_docs, fit(no_docs, labels, label), "out").count() == 0


def test_label_model_finds_good_voters_and_company():
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.3
    v = np.array([np.where(rng.random(20000) < a, y, ~y) for a in (0.9, 0.8, 0.7, 0.6)] + [rng.random(20000) < 0.5]).T.astype(float)
    v = np.hstack([v, v[:, 1:2]])                      # the last copies the second
    acc, company = toxicity.label_model(len(v), v.sum(0), v.T @ v, 0.3)
    assert acc[0] > acc[2] > acc[3] and acc[4] < 0.35
    assert company[1, 5] and company[5, 1] and not company[0, 2]


def test_toxicity_against_plain_numpy(spark):
    """Moments, label model, posteriors and classifier over one whole table, held in memory."""
    docs = table(spark, SF, "documents")
    model = toxicity_model(spark, SF, docs)
    rows = docs.select("doc_id", "text").collect()
    got = [model.lexicon.votes(r.text or "") for r in rows]
    v, x = np.array([g[0] for g in got], float), np.array([g[1] for g in got])
    mean, spread = v.mean(0), np.sqrt(np.maximum(v.var(0), 1e-10))
    acc, company = toxicity.label_model(len(v), v.sum(0), v.T @ v, model.prior)
    assert np.allclose(acc, model.accuracy) and (company == model.correlated).all()
    target = np.empty(len(v))
    for i, row in enumerate(v):
        odds = math.log(model.prior / (1 - model.prior))
        for k in range(len(row)):
            if acc[k] > 0:
                sd = math.sqrt(model.prior * (1 - model.prior))
                yes = [min(max(mean[k] + acc[k] * spread[k] * (y - model.prior) / sd, 1e-3), 1 - 1e-3) for y in (0, 1)]
                ratio = yes[1] / yes[0] if row[k] else (1 - yes[1]) / (1 - yes[0])
                odds += math.log(ratio) / (1 + company[k].sum())
        target[i] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    p = 1 / (1 + np.exp(-np.clip(x @ model.linear, -30, 30)))
    assert np.abs(x.T @ (p - target) + model.linear).max() < 1e-3          # the ridge loss has no slope left
    score = {r.doc_id: r.score for r in QUERIES["op5_toxicity"](spark, SF).collect()}
    assert all(abs(score[r.doc_id] - q) < 1e-6 for r, q in zip(rows, p))


def test_toxicity_learns_from_texts_without_labels(spark):
    """Labels of 300 of 6,000 documents choose the voters; the classifier's targets come from all texts and from no label."""
    docs, labels = toxic_table(spark, 0, made_up(10, 7), 3, 0.002)
    few = toxicity.fit(docs, labels.where("doc_id % 20 = 0"), "toxic")
    got = toxicity.score(docs, few).join(labels, "doc_id").where("doc_id % 20 <> 0").toPandas()
    assert (got.score >= 0.7)[got.toxic == 1].mean() >= 0.9 and (got.score >= 0.7)[got.toxic == 0].mean() <= 0.05
    views = toxicity._views(docs, spark.sparkContext.broadcast(few.lexicon))
    assert toxicity._moments(views)[0] == 6000


def test_toxicity_recall_by_language(spark):
    got = (QUERIES["op5_toxicity"](spark, LARGE).join(table(spark, LARGE, "labels"), "doc_id").where("held_out and toxic = 1")
           .join(table(spark, LARGE, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang")
           .agg(F.avg("predicted").alias("recall"), F.count("*").alias("n")).collect())
    assert {r.lang for r in got} and all(r.recall >= 0.6 for r in got if r.n >= 10), got


def test_quality_against_a_plain_vote(spark):
    """Every score is the similarity-weighted vote of the nearest labelled vectors, ties together."""
    docs = table(spark, SF, "documents")
    model = quality_model(spark, SF, docs)
    rows = docs.select("doc_id", "text").where("crc32(cast(doc_id as string)) % 7 = 0").collect()
    score = {r.doc_id: r.score for r in QUERIES["op7_quality_classifier"](spark, SF).collect()}
    for r in rows:
        terms = np.concatenate([*quality.term_counts(pa.array([r.text or ""]))])
        if not terms.any():
            assert score[r.doc_id] == pytest.approx(model.share)
            continue
        near = sorted(((float(c), k) for k, c in enumerate((model.latent(terms) @ model.vectors.T)[0])), reverse=True)
        last = near[min(quality.NEIGHBOURS, len(near)) - 1][0]
        yes = no = 0.0
        for c, k in near:
            if c >= last:
                w = max(c, 1e-6) ** quality.SHARPNESS * model.weights[k]
                yes, no = yes + w * (model.labels[k] == 1), no + w * (model.labels[k] == 0)
        assert score[r.doc_id] == pytest.approx(yes / (yes + no), abs=2e-3), r.doc_id


def made_up(n, seed):
    return ["".join(w) for w in np.random.default_rng(seed).choice(list("abcdefghijklmnopqrstuvwxyz"), (n, 9))]


def toxic_table(spark, copies, words, per_text, noise, n=6000, share=0.1):
    """Documents and labels: toxic ones hold ``per_text`` of ``words``, clean ones each with probability ``noise``; of the toxic
    ones ``copies`` are the same long text without any."""
    rng = np.random.default_rng(5)
    long = " ".join(made_up(400, 6))
    docs, labels = [], []
    for i in range(n):
        toxic = i < share * n
        own = rng.choice(words, per_text, replace=False) if toxic else [w for w in words if rng.random() < noise]
        text = long if i < copies else " ".join(rng.permutation([*own, *(f"plain{k}" for k in rng.integers(0, 2000, 60))]))
        docs.append((i, text))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.mark.parametrize("copies,words,per_text,noise", [
    (200, made_up(10, 7), 3, 0.0),          # a group of copies among the toxic texts
    (0, made_up(10, 7), 3, 0.005),          # the words in clean texts too
    (0, made_up(370, 8), 6, 0.0)])         # each in under 2 % of the toxic texts, on average
def test_learnt_words_without_the_fixed_list(spark, monkeypatch, copies, words, per_text, noise):
    docs, labels = toxic_table(spark, copies, words, per_text, noise)
    model = toxicity.fit(docs, labels, "toxic", lambda i: i % 3 != 1)
    texts = [t.split() for _, t, y in docs.join(labels, "doc_id").where("doc_id % 3 != 1").select("doc_id", "text", "toxic").collect() if y]
    often = {w for w in words if sum(w in t for t in texts) >= toxicity.MIN_COUNT}
    assert len(often) > 0.6 * len(words) and often <= set(model.lexicon.words)
    got = toxicity.score(docs, model).join(labels, "doc_id").where(f"doc_id % 3 = 1 and doc_id >= {copies}").toPandas()
    found = got.score >= 0.7
    assert found[got.toxic == 1].mean() >= 0.9 and found[got.toxic == 0].mean() <= 0.05


def test_near_copies_do_not_crowd_out_the_learnt_words(spark):
    """A long toxic text that comes 200 times, 1 word in 30 changed: its 1,500 words are in more toxic texts than any real one."""
    words, rng = made_up(10, 7), np.random.default_rng(9)
    docs, labels = toxic_table(spark, 0, words, 3, 0.0)
    long = np.array(made_up(1500, 11))
    near = [(6000 + i, " ".join(np.where(rng.random(1500) < 1 / 30, f"other{i}", long))) for i in range(200)]
    docs = docs.unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    model = toxicity.fit(docs, labels.unionByName(spark.createDataFrame([(i, 1) for i, _ in near], "doc_id long, toxic int")),
                         "toxic", lambda i: i % 3 != 1)
    assert set(words) <= set(model.lexicon.words) and len(set(long) & set(model.lexicon.words)) < 15
    got = toxicity.score(docs, model).join(labels, "doc_id").where("doc_id % 3 = 1").toPandas()
    assert (got.score >= 0.7)[got.toxic == 1].mean() >= 0.9 and (got.score >= 0.7)[got.toxic == 0].mean() <= 0.05


def test_toxic_words_of_four_languages_among_rare_words(spark):
    """Texts of a language hold its own toxic words and rare words, each in few texts, that come with label 1 by chance."""
    rng, docs, labels = np.random.default_rng(3), [], []
    own = [made_up(10, 20 + k) for k in range(4)]
    rare = [made_up(6000, 30 + k) for k in range(4)]
    for i in range(6000):
        lang, toxic = i % 4, int(rng.random() < 0.1)
        docs.append((i, " ".join([*rng.choice(rare[lang], 40), *(f"plain{k}" for k in rng.integers(0, 200, 40)), *rng.choice(own[lang], 3 * toxic)])))
        labels.append((i, toxic))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, "toxic", lambda i: i % 3 != 1)
    known = set(model.lexicon.words)
    assert {w for o in own for w in o} <= known and len(known & {w for r in rare for w in r}) <= 10
    got = toxicity.score(docs, model).join(labels, "doc_id").where("doc_id % 3 = 1").toPandas()
    for lang in range(4):
        g = got[got.doc_id % 4 == lang]
        assert (g.score >= 0.7)[g.toxic == 1].mean() >= 0.9 and (g.score >= 0.7)[g.toxic == 0].mean() <= 0.02, lang


def test_strength_and_bands():
    assert toxicity.least_strength({100: 5}, 10 ** 6) == 100 and toxicity.least_strength({7: 5}, 10 ** 6) == math.inf
    assert toxicity.least_strength({6: 50}, 100) == toxicity.MIN_G2 and toxicity.least_strength({}, 9) == math.inf
    text = " ".join(made_up(300, 1))
    arr = pa.array([text, text.replace("a", "b", 3), " ".join(made_up(300, 2)), "one two", ""])
    (_, _, words, woff), = hashed_words(arr)
    bands = toxicity._bands(words, woff)
    assert (bands[0] == bands[1]).any() and not (bands[0] == bands[2]).any() and not bands[3:].any()


# ---------------------------------------------------------------- preferences

TURNS = "conv_id long, turn long, role string, text string, part string, train string, pair_id string"


def turn(c, t, role, text):
    return c, t, role, text, "x", "x", "x"


def test_preferences(spark):
    rows = [turn(0, 0, "user", "hi"), turn(0, 1, "assistant", "a"), turn(0, 2, "user", "more"), turn(0, 3, "assistant", "good"),
            turn(1, 0, "user", "hi"), turn(1, 1, "assistant", "a"), turn(1, 2, "user", "more"), turn(1, 3, "assistant", "bad"),
            turn(2, 0, None, None), turn(2, 0, None, None), turn(3, 0, "", ""),                # repeated on one side
            turn(4, 5, "user", "same"), turn(5, 5, "user", "same"),                            # equal sides
            turn(6, None, "system", "s"), turn(6, 0, "assistant", "alone"),                    # a side is missing
            turn(None, 0, "user", "lost")]
    pair, side = F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 != 0
    got = preferences.preference_turns(spark.createDataFrame(rows, TURNS), pair, side).collect()
    flat = Counter((r.pair_id, r.part, r.turn, r.role, r.train) for r in got)
    assert flat == Counter([(0, "prompt", 0, "user", False), (0, "prompt", 1, "assistant", False), (0, "prompt", 2, "user", False),
                            (0, "chosen", 3, "assistant", True), (0, "rejected", 3, "assistant", True),
                            (1, "chosen", 0, "", False), (1, "chosen", 0, "", False), (1, "rejected", 0, "", False),
                            (2, "prompt", 5, "user", False), (3, "chosen", -1, "system", False), (3, "chosen", 0, "assistant", True)])
    assert "<|im_start|>assistant\ngood<|im_end|>\n" in {r.rendered for r in got}
    assert preferences.preference_turns(spark.createDataFrame([], TURNS), pair, side).count() == 0


def test_preferences_use_no_python(spark):
    plan = QUERIES["op6_preference_formatting"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# ---------------------------------------------------------------- top k

def plain_top_k(rows, k):
    kept = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(64 * x) for x in v]
            kept[i] = w
    out = []
    for q, v in kept.items():
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in kept.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("tree", [mtree.TREE, 16])
def test_top_k(spark, tree):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)] + [(300 + i, [0.5] * 6) for i in range(150)]      # a hot vector
    rows += [(1000, None), (1020, [1.0, None]), (1040, [float("nan")] * 6), (1060, [float("inf")] * 6), (None, [1.0] * 6),
             (1080, []), (1100, [3.0, -2.0]), (1120, [0.0] * 6)]
    given = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    got = mtree.top_k(given, lambda c: c % 20 == 0, tree=tree).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == plain_top_k(rows, 20)


def test_top_k_of_little(spark):
    shape = "vec_id long, embedding array<float>"
    assert mtree.top_k(spark.createDataFrame([], shape), lambda c: c % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0])], shape)
    assert [tuple(r) for r in mtree.top_k(few, lambda c: c % 20 == 0).collect()] == [(0, 1, 1, 64 * 128)]
    with pytest.raises(Exception, match="64 bits"):
        mtree.top_k(spark.createDataFrame([(0, [1e30])], shape), lambda c: c % 20 == 0).count()


def clustered():
    rng = np.random.default_rng(1)
    m = np.round(np.concatenate([rng.normal(c, 1, (500, 3)) for c in (0, 100, 200, 300)]) * 64).astype(np.int64)
    return m, mtree.Space(3, float((m * m).sum(1).max()))


def test_nodes_cover_what_is_below_them():
    m, space = clustered()
    root = space.lift(m[:1])[0]
    nodes = mtree._nodes(np.arange(2000), m, space, root, page=16, fan=4)
    parents = {r[0]: r[1] for r in nodes}
    routes = {-1: root, **{r[0]: np.frombuffer(r[2]) for r in nodes}}
    seen = []
    for node, parent, _, _, at, entry, ids, _ in nodes:
        assert abs(np.linalg.norm(routes[node] - routes[parent]) - at) < 1e-3 * (1 + at)
        if ids is None:
            assert 0 < list(parents.values()).count(node) <= 8
            continue
        seen += np.frombuffer(ids, np.int64).tolist()
        depth, up = 0, node
        while up != -1:                                            # every node above covers the leaf's vectors
            far = np.linalg.norm(space.lift(m[np.frombuffer(ids, np.int64)]) - routes[up], axis=1).max()
            assert far <= nodes[up][3] + space.margin
            depth, up = depth + 1, parents[up]
        assert depth >= 3
    assert sorted(seen) == list(range(2000))


def test_search_computes_few_distances():
    m, space = clustered()
    root = space.lift(m[:1])[0]
    tree = mtree.Tree(root, mtree._nodes(np.arange(2000), m, space, root, page=16, fan=4), space)
    got = list(tree.search(np.array([1999]), m[1999:], np.array([np.iinfo(np.int64).min]), 20))
    s = m @ m[1999]
    want = sorted((-int(x), i) for i, x in enumerate(s) if i != 1999)[:20]
    assert [(-x, i) for _, i, x in got] == want and tree.computed < 600
    tree.computed, best = 0, np.array([int(s.max()) + 1])          # nothing reaches this floor
    assert not list(tree.search(np.array([1999]), m[1999:], best, 20)) and tree.computed < 100


def test_a_block_of_queries_visits_a_node_once(monkeypatch):
    """In 64 dimensions without clusters no bound closes a node; each is visited by all queries together, and ties keep the smaller ids."""
    rng = np.random.default_rng(2)
    m = np.round(rng.normal(size=(600, 64)) * 4).astype(np.int64)
    m[100:180] = m[100]                                            # a common vector
    space, pushed = mtree.Space(64, float((m * m).sum(1).max())), []
    root = space.lift(m[:1])[0]
    tree = mtree.Tree(root, mtree._nodes(np.arange(600), m, space, root, page=16, fan=4), space)
    push = mtree.heapq.heappush
    monkeypatch.setattr(mtree.heapq, "heappush", lambda heap, x: (pushed.append(x), push(heap, x)))
    own = np.arange(90, 154)
    s = m @ m[own].T
    want = [(i, j, int(x)) for k, i in enumerate(own) for x, j in sorted(((-s[j, k], j) for j in range(600) if j != i))[:20] for x in [-x]]
    for floor in (np.full(64, np.iinfo(np.int64).min), np.sort(s, axis=0)[-21]):
        pushed.clear()
        assert list(tree.search(own, m[own], floor, 20)) == want
        assert len(pushed) <= len(tree.radius)


def test_blocks_meet_only_regions_in_reach():
    m, space = clustered()
    roots = space.lift(m[[0, 500, 1000, 1500]])
    radius = np.array([farthest(m[a:a + 500], r, space) for a, r in zip((0, 500, 1000, 1500), roots)])
    floor = np.sort(m @ m[1999])[[-21]]
    assert mtree.open_regions(m[1999:], floor, roots, radius, space).tolist() == [3]
    assert mtree.open_regions(m[1999:], np.array([np.iinfo(np.int64).min]), roots, radius, space).tolist() == [0, 1, 2, 3]
    radius[1] = -1                                                 # a region without vectors
    assert mtree.open_regions(m[1999:], np.array([np.iinfo(np.int64).min]), roots, radius, space).tolist() == [0, 2, 3]


def farthest(m, root, space):
    return float(mtree.Space.distances(space.lift(m), root[None]).max())


# ---------------------------------------------------------------- the pipeline

def test_pipeline(spark, monkeypatch):
    from test_text_operators import check_packing, linked, removed

    docs = table(spark, SF, "documents")
    names = docs.columns
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in kept.collect()}
        out = stage(spark, kept, SF)
        if k < 4:
            assert out.columns == names
            after = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
            assert set(after) <= set(before)
        if name == "n-gram Jaccard join":
            want = {c for _, c, _ in linked(list(before.items()))}
            assert set(after) == want
        elif name == "substring dedup":
            rows = sorted(before.items())
            for (i, t), w in zip(rows, removed(rows)):
                new = t if len(w) == len(t.encode().split()) else " ".join(w)
                assert after[i] == (new, len(new))
        elif name == "best-fit packing":
            check_packing(out.collect(), list(before.items()), 2048)
        else:
            assert len(before) * 0.5 < len(after) < len(before)
        kept = out
    assert corpus_pipeline.run(spark, SF).count() == kept.count()


def test_stages_on_edge_rows_and_empty_tables(spark, edge, no_docs, tmp_path):
    spark.createDataFrame([(i, 1, int(i == 12)) for i in range(4, 14)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for given in (edge, no_docs):
        docs = given
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            if k < 4:
                assert docs.columns == given.columns
        assert (docs.count() > 0) == (given is edge)


def test_entry_point_has_the_queries():
    import __spark_entry__

    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in QUERIES}
    assert os.path.exists(corpus_pipeline.__file__) and [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier"


def test_votes_are_those_of_the_nearest_vectors():
    """Against a plain vote; vectors as near as the last neighbour all vote."""
    rng = np.random.default_rng(5)
    project = rng.normal(size=(quality.TERMS, 6))
    vectors = rng.normal(size=(60, 6)).astype(np.float32)
    vectors[40:] = vectors[7]                                        # ties
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels, weights = rng.integers(0, 2, 60).astype(float), rng.uniform(0.5, 1, 60)
    model = quality.Model(project, vectors, labels, weights, 0.25)
    terms = np.vstack([rng.random((20, quality.TERMS)), np.zeros(quality.TERMS)])
    got = model.score(terms, neighbours=5, block=7)
    assert got[-1] == 0.25                                           # no terms
    for t, s in zip(terms[:-1], got):
        x = (t @ project).astype(np.float32)
        cos = (x / np.linalg.norm(x)) @ vectors.T
        near = [k for k in range(60) if cos[k] >= sorted(cos)[-5] - 1e-6]
        w = {k: max(float(cos[k]), 1e-6) ** quality.SHARPNESS * weights[k] for k in near}
        assert s == pytest.approx(sum(w[k] * labels[k] for k in near) / sum(w.values()), rel=1e-3, abs=1e-9)


def test_repeated_rows_of_a_labelled_id_are_learnt_once(spark):
    rows = [(1, f"fine text number {k % 7}") for k in range(200)] + [(2, "vile scoundrel"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(quality.fit(docs, labels, "quality").vectors) == 3
    sample, sizes = toxicity._sample(docs, labels, "toxic", lambda doc_id: F.lit(True), 10)
    assert sizes == {0: 2, 1: 1} and sample.count() == 3              # id 99 has no text
    got = toxicity.score(docs, toxicity.fit(docs, labels, "toxic"))
    assert got.count() == len(rows) and got.where("not score between 0 and 1").count() == 0
