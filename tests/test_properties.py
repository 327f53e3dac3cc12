"""Properties of the sampling operators, including the code paths only large inputs take."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from oracle_harness import SF
from labelwise.functions.text import hash_key
from labelwise.operators import splits
from labelwise.operators.indexing import ordinal_positions
from labelwise.operators.splits import bootstrap_sample, eval_pool, stratified_split
from labelwise.sources.tables import labeled_keys


def _keys(spark):
    return labeled_keys(spark, SF["0.01"])


def _rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_split_sizes_disjoint(spark):
    a = stratified_split(_keys(spark), 30, 20)
    got = {(r["label"], r["split"]): r["n"] for r in a.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    assert got == {("positive", "train"): 30, ("positive", "test"): 20, ("negative", "train"): 30,
                   ("negative", "test"): 20}
    assert a.select("row_id").distinct().count() == 100


def test_prefilter_path_is_exact(spark, monkeypatch):
    """Force the candidate pre-filter on small data: the result must equal the unfiltered ranking."""
    keys = _keys(spark)
    plain = _rows(stratified_split(keys, 10, 5), "row_id", "label", "split", "rank")
    monkeypatch.setattr(splits, "PREFILTER_MIN_ROWS", 0)
    filtered_df = stratified_split(keys, 10, 5)
    assert _rows(filtered_df, "row_id", "label", "split", "rank") == plain


def test_prefilter_shortfall_fails_loudly(spark, monkeypatch):
    monkeypatch.setattr(splits, "PREFILTER_MIN_ROWS", 0)
    monkeypatch.setattr(splits, "_threshold", lambda n, need: 1)   # keep almost nothing
    with pytest.raises(Exception, match="shortfall"):
        stratified_split(_keys(spark), 10, 5).collect()


def test_strict_eval_is_leak_free_reference_keeps_positive_leak(spark):
    keys = _keys(spark)
    a = stratified_split(keys, 30, 20)
    strict = eval_pool(keys, a, policy="strict")
    assert strict.join(a, "row_id").count() == 0
    ref = eval_pool(keys, a, policy="reference")
    assert ref.join(a.where("label = 'negative'"), "row_id").count() == 0
    assert ref.join(a.where("label = 'positive'"), "row_id").count() == 50


@pytest.mark.parametrize("parts", [1, 8, 200])
def test_same_result_any_partitioning(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        keys = _keys(spark).repartition(parts)
        a = stratified_split(keys, 30, 20)
        got = (_rows(a, "row_id", "split"), _rows(bootstrap_sample(eval_pool(keys, a), 20), "label", "draw", "row_id"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    base_keys = _keys(spark)
    base_a = stratified_split(base_keys, 30, 20)
    assert got == (_rows(base_a, "row_id", "split"),
                   _rows(bootstrap_sample(eval_pool(base_keys, base_a), 20), "label", "draw", "row_id"))


@pytest.mark.parametrize("prefix_len", [1, 2])
def test_two_level_index_equals_global_row_number(spark, prefix_len):
    df = _keys(spark).withColumn("_key", hash_key(7, F.col("row_id")))
    two = ordinal_positions(df, "_key", ["row_id"], partition_cols=["label"], prefix_len=prefix_len, out="pos",
                            max_groups=2)
    one = df.withColumn("pos", F.row_number().over(Window.partitionBy("label").orderBy("_key", "row_id")) - 1)
    assert _rows(two, "row_id", "pos") == _rows(one, "row_id", "pos")


@pytest.mark.parametrize("prefix_len", [1, 2, 4])
def test_bootstrap_any_bucket_width(spark, prefix_len):
    pool = _keys(spark)
    ref = _rows(bootstrap_sample(pool, 25, prefix_len=4), "label", "draw", "row_id")
    assert _rows(bootstrap_sample(pool, 25, prefix_len=prefix_len), "label", "draw", "row_id") == ref
    assert len(ref) == 50


def test_confusion_sums_and_macro_bound(spark):
    from labelwise.plans import catalog
    conf = catalog.q_confusion_counts(spark, SF["0.01"])
    assert {r["phase"]: r["s"] for r in conf.groupBy("phase").agg(F.sum("n").alias("s")).collect()} == \
        {"before": 40, "after": 40}
    for r in catalog.q_eval_binary(spark, SF["0.01"]).collect():
        assert r["f1_macro"] <= max(r["f1_0"], r["f1_1"]) + 1e-9


def test_stream_replay_is_idempotent(spark, tmp_folder):
    from labelwise.plans.catalog import cycled
    from labelwise.streaming.cycles import stream_counts, write_batches
    src = cycled(spark, SF["0.001"]).select("cycle", "row_id", "label", "text")
    write_batches(src, tmp_folder + "/in")
    first = _rows(stream_counts(spark, tmp_folder + "/in", src.schema, tmp_folder + "/out", tmp_folder + "/ck1"),
                  "cycle", "token", "n_positive", "n_negative")
    # a fresh checkpoint replays every batch into the same table: nothing changes
    again = _rows(stream_counts(spark, tmp_folder + "/in", src.schema, tmp_folder + "/out", tmp_folder + "/ck2"),
                  "cycle", "token", "n_positive", "n_negative")
    assert first == again


def test_large_class_two_level_rank_path(spark, monkeypatch):
    """need * 4 >= n on a 'large' class: ranks come from the two-level index, equal to the plain window."""
    keys = _keys(spark)
    plain = _rows(stratified_split(keys, 30, 20), "row_id", "label", "split", "rank")
    monkeypatch.setattr(splits, "PREFILTER_MIN_ROWS", 10)
    monkeypatch.setattr(splits, "_threshold", lambda n, need: None)
    assert _rows(stratified_split(keys, 30, 20), "row_id", "label", "split", "rank") == plain


def test_stream_counts_with_many_files_per_cycle(spark, tmp_folder):
    """Rows of one cycle spread over several files (several micro-batches) still add up."""
    from labelwise.plans.catalog import cycled
    from labelwise.streaming.cycles import stream_counts
    from labelwise.operators.naive_bayes import keyed_token_counts
    src = cycled(spark, SF["0.001"]).select("cycle", "row_id", "label", "text")
    src.repartition(5).write.parquet(tmp_folder + "/in")          # every cycle in every file
    got = _rows(stream_counts(spark, tmp_folder + "/in", src.schema, tmp_folder + "/out", tmp_folder + "/ck"),
                "cycle", "token", "n_positive", "n_negative")
    assert got == _rows(keyed_token_counts(src, "cycle"), "cycle", "token", "n_positive", "n_negative")


@pytest.mark.parametrize("prefix_len", [1, 3, 6])
def test_bootstrap_equals_brute_force(spark, prefix_len):
    """Draw j of label L is pool row number int(md5('10:L:j')[:15], 16) mod |pool| in md5('10:id') order."""
    import hashlib
    pool = _keys(spark)
    by_label = {}
    for r in pool.collect():
        by_label.setdefault(r["label"], []).append(r["row_id"])
    want = []
    for label, ids in by_label.items():
        order = sorted(ids, key=lambda i: (hashlib.md5(f"10:{i}".encode()).hexdigest(), i))
        for j in range(1, 201):
            idx = int(hashlib.md5(f"10:{label}:{j}".encode()).hexdigest()[:15], 16) % len(order)
            want.append((label, j, order[idx]))
    got = _rows(bootstrap_sample(pool, 200, prefix_len=prefix_len), "label", "draw", "row_id")
    assert got == sorted(want, key=repr)


def test_prefilter_window_path_is_exact(spark, monkeypatch):
    """Pre-filtered candidates few enough for one window per class (the sentinel path) give the plain
    result."""
    keys = _keys(spark)
    plain = _rows(stratified_split(keys, 10, 5), "row_id", "label", "split", "rank")
    monkeypatch.setattr(splits, "PREFILTER_MIN_ROWS", 200)   # positive (341 rows) is pre-filtered
    got = stratified_split(keys, 10, 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "_bucket" not in plan      # one window per class, not the two-level index
    assert _rows(got, "row_id", "label", "split", "rank") == plain


def test_prefilter_window_shortfall_fails_loudly(spark, monkeypatch):
    monkeypatch.setattr(splits, "PREFILTER_MIN_ROWS", 200)
    monkeypatch.setattr(splits, "_threshold", lambda n, need: 1 if n > 200 else None)
    with pytest.raises(Exception, match="shortfall"):
        stratified_split(_keys(spark), 10, 5).collect()


def test_draws_reach_beyond_32_bits(spark):
    """A draw's index is taken from 60 bits: over a pool larger than 2^32 some draws land in its upper part."""
    from labelwise.functions.text import hex_prefix_int
    from labelwise.operators.splits import DRAW_DIGITS
    got = (spark.range(1, 400).select(F.pmod(hex_prefix_int(F.md5(F.concat(F.lit("10:positive:"), F.col("id").cast("string"))), DRAW_DIGITS),
                                             F.lit(1 << 40)).alias("i")))
    assert got.where(F.col("i") >= 1 << 32).count() > 390 and got.where(F.col("i") >= 1 << 39).count() > 100


def test_missing_flag_is_no_class(spark, tmp_path):
    """A NULL flag stays a NULL label: in no class, in no pool, in the full train set as a missing label."""
    from labelwise.plans.dataset import full_train
    docs = [(i, f"text {i}") for i in range(30)]
    flags = [(i, None if i % 5 == 0 else i % 2, 0) for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(flags, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    keys = labeled_keys(spark, str(tmp_path))
    assert keys.where("label is null").count() == 6
    a = stratified_split(keys, 3, 2)
    assert a.where("label is null").count() == 0
    for policy, n in (("strict", 14), ("reference", 19)):
        pool = eval_pool(keys, a, policy=policy)
        assert pool.where("label is null").count() == 0 and pool.count() == n
    train = full_train(spark, str(tmp_path)).collect()
    assert len(train) == 30 and sum(r["prompt"].endswith("] = nan") for r in train) == 6


def test_a_cycle_is_written_by_several_tasks(spark, tmp_path):
    from labelwise.plans.catalog import cycled
    from labelwise.streaming.cycles import write_batches
    write_batches(cycled(spark, SF["0.001"]).repartition(4), f"{tmp_path}/in")
    files = spark.read.parquet(f"{tmp_path}/in").where("_batch = 1").select(F.input_file_name().alias("f")).distinct().count()
    assert files > 1


def test_streams_without_batches_are_empty(spark, tmp_path):
    import os

    from labelwise.streaming.cycles import stream_confusion, stream_counts
    os.makedirs(f"{tmp_path}/none")
    counts = stream_counts(spark, f"{tmp_path}/none", "cycle int, row_id long, label string, text string", f"{tmp_path}/a", f"{tmp_path}/b")
    assert counts.columns == ["cycle", "token", "n_positive", "n_negative"] and counts.count() == 0
    conf = stream_confusion(spark, f"{tmp_path}/none", "phase string, label string, raw string", f"{tmp_path}/c", f"{tmp_path}/d")
    assert conf.columns == ["phase", "y_true", "y_pred", "n"] and conf.count() == 0


def test_logistic_regression_learns_separable_texts(spark):
    from labelwise.operators.ml import lr_fit, lr_predict
    rows = [(i, "positive" if i % 2 else "negative", ("good fine " if i % 2 else "bad poor ") + f"w{i % 7}") for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, label string, text string")
    got = lr_predict(lr_fit(df.where("row_id < 150"), num_features=1 << 10), df.where("row_id >= 150"))
    assert got.where("label = pred").count() == 50


def test_class_without_documents_scores_alike(spark):
    """A class that no training document has: minus infinity from both the single and the keyed model."""
    from labelwise.operators import naive_bayes as NB
    docs = spark.createDataFrame([(1, "positive", "a b"), (2, "positive", "b c")], "row_id long, label string, text string")
    test = spark.createDataFrame([(5, "a c x"), (6, "")], "row_id long, text string")
    one = {r.row_id: r for r in NB.predict(NB.fit(NB.token_counts(docs)), test).collect()}
    counts = NB.keyed_token_counts(docs.withColumn("k", F.lit(1)), "k")
    many = NB.keyed_predict(counts, NB.keyed_params(counts, "k"), test.withColumn("k", F.lit(1)), "k").collect()
    for r in many:
        assert r.pred == one[r.row_id].pred == "positive" and r.score_negative == one[r.row_id].score_negative == float("-inf")
        assert r.score_positive == pytest.approx(one[r.row_id].score_positive)


def test_scoring_paths_agree(spark, monkeypatch):
    """The broadcast predictor and the native join give the same answers, for every turn."""
    from labelwise.functions.prompts import test_prompt as prompt
    from labelwise.operators import naive_bayes as NB
    from labelwise.operators.scoring import nb_answers
    from labelwise.plans.catalog import nb_model
    from labelwise.sources.tables import unlabelled
    model = nb_model(spark, SF["0.01"])
    prompts = unlabelled(spark, SF["0.01"]).select("conv_id", "turn", prompt(F.col("text")).alias("prompt"))
    fast = _rows(nb_answers(spark, model, prompts, ["conv_id", "turn"]), "conv_id", "turn", "answer")
    monkeypatch.setattr(NB.NBModel, "broadcastable", lambda self: False)
    assert _rows(nb_answers(spark, model, prompts, ["conv_id", "turn"]), "conv_id", "turn", "answer") == fast
    assert len(fast) == spark.read.parquet(f"{SF['0.01']}/conversations.parquet").count()


def test_approximate_split_is_stable_and_within_its_spread(spark):
    from labelwise.operators.splits import fraction_split_approx, fraction_spread

    rows = spark.range(40000).withColumnRenamed("id", "row_id")
    split = fraction_split_approx(rows, 0.7, 0.2, 0.1)
    sizes = {r.split: r for r in fraction_spread(split, 0.7, 0.2, 0.1).collect()}
    assert {k: r.expected for k, r in sizes.items()} == {"train": 28000, "eval": 8000, "test": 4000}
    assert sum(r.n for r in sizes.values()) == 40000 and all(abs(r.deviations) < 4 for r in sizes.values())
    few = fraction_split_approx(rows.where("row_id % 7 = 3").repartition(3), 0.7, 0.2, 0.1)
    assert few.join(split.withColumnRenamed("split", "whole"), "row_id").where("split <> whole").count() == 0
    empty = fraction_split_approx(spark.createDataFrame([], "row_id long"))
    assert {(r.split, r.n, r.deviations) for r in fraction_spread(empty).collect()} == {(s, 0, None) for s in ("train", "eval", "test")}
    odd = spark.createDataFrame([(None,), (1,), (1,)], "row_id long")
    assert fraction_split_approx(odd).where("split is null").count() == 0


def test_laid_out_tables_hold_the_same_rows(spark):
    from labelwise.sources import layout
    from labelwise.sources.tables import read_table

    plain = _rows(read_table(spark, SF["0.001"], "documents"), "doc_id", "text", "lang")
    with layout.laid_out(spark, SF["0.001"], 5):
        table = read_table(spark, SF["0.001"], "documents")
        assert _rows(table, "doc_id", "text", "lang") == plain
    assert _rows(read_table(spark, SF["0.001"], "documents"), "doc_id", "text", "lang") == plain


def _plain_linear(rows, steps, buckets):
    """The perceptron steps with plain Python: score of every row."""
    import hashlib
    import re

    feats = [{int(hashlib.md5(w.encode()).hexdigest()[:15], 16) % buckets for w in re.findall(r"[^\W_]+", (t or "").lower())} for _, _, t in rows]
    y = [{"positive": 1, "negative": -1}.get(lab) for _, lab, _ in rows]
    p, m = y.count(1), y.count(-1)
    factor = {1: max(1, m // max(p, 1)), -1: max(1, p // max(m, 1))}
    w, total = [0] * buckets, [0] * buckets
    for _ in range(steps):
        wrong = [k for k, f in enumerate(feats) if y[k] and y[k] * sum(w[b] for b in f) <= 0]
        for k in wrong:
            for b in feats[k]:
                w[b] += y[k] * factor[y[k]]
        total = [a + b for a, b in zip(total, w)]
    return [sum(total[b] for b in f) for f in feats]


def test_linear_model_is_the_plain_perceptron(spark):
    from labelwise.operators.linear import fit_linear, hashed_words, predict_linear

    good, bad = "sun warm bright kind", "rain cold dark rude"
    rows = [(k, "positive" if k % 3 else "negative", " ".join(((good if k % 3 else bad) + " the and of").split()[k % 4:])) for k in range(60)]
    rows += [(100, "positive", None), (101, "negative", ""), (102, "neutral", "sun rain"), (103, None, "warm"), (1, "positive", rows[1][2])]
    df = spark.createDataFrame(rows, "row_id long, label string, text string").repartition(5)
    feats = hashed_words(df, 64)
    got = predict_linear(fit_linear(feats, 5, 64), feats).collect()
    assert sorted((r.row_id, r.score) for r in got) == sorted((r[0], s) for r, s in zip(rows, _plain_linear(rows, 5, 64)))
    right = [r.pred == r.label for r in got if r.row_id < 60]
    assert sum(right) >= 0.95 * len(right)
    none = fit_linear(feats.where("false"), 2, 64)
    assert {r.score for r in predict_linear(none, feats).collect()} == {0}


def test_metric_log_keeps_one_record_of_each(spark, tmp_folder):
    from labelwise.plans.sinks import METRICS_SCHEMA, log_metrics, read_log

    def rows(run, phase, value):
        return spark.createDataFrame([(run, "d", "m", "eval", phase, "f1", value)], METRICS_SCHEMA)

    folder = tmp_folder + "/log"
    for run, phase, value, attempt in (("a/b", "before", 1.0, 1), ("a/b", "before", 2.0, 1), ("a/b", "after", 3.0, 2), ("a/b", "after", 9.0, 1),
                                       ("c", "before", 4.0, 1)):
        log_metrics(rows(run, phase, value), folder, attempt)
    assert sorted((r.run_id, r.phase, r.value) for r in read_log(spark, folder).collect()) == [("a/b", "after", 3.0), ("a/b", "before", 2.0), ("c", "before", 4.0)]


def test_model_versions_are_pruned_and_replaced(spark, tmp_folder):
    from labelwise.plans.sinks import load_version, publish_version, published_version, save_version

    def counts(n):
        return spark.createDataFrame([(k, "w", n + k, 0) for k in range(3)], "cycle int, token string, n_positive long, n_negative long")

    folder = tmp_folder + "/store"
    with pytest.raises(ValueError, match="no published version"):
        load_version(spark, folder, "r")
    for run, version, n in (("r", 1, 10), ("r", 2, 20), ("q", 5, 50), ("r", 2, 30)):
        save_version(counts(n), folder, run, version)
    publish_version(spark, folder, "r", 1)
    publish_version(spark, folder, "q", 5)
    assert sorted(r.n_positive for r in load_version(spark, folder, "r").collect()) == [10, 11, 12]
    publish_version(spark, folder, "r", 2)
    assert (published_version(spark, folder, "r"), published_version(spark, folder, "q")) == (2, 5)
    df = load_version(spark, folder, "r", cycles=[1])
    assert [r.n_positive for r in df.collect()] == [31]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert all(c in plan.split("PartitionFilters: [")[1].split("]")[0] for c in ("run_id", "cycle", "version"))


def test_replayed_version_changes_nothing(spark, tmp_folder):
    from labelwise.streaming.cycles import test_then_train as feed

    rows = spark.createDataFrame([(k, "positive" if k % 3 else "negative", f"{'sun' if k % 3 else 'rain'} day {k % 5}") for k in range(300)],
                                 "row_id long, label string, text string")
    source, store, ckpt = (f"{tmp_folder}/{x}" for x in ("in", "store", "ckpt"))
    for k in range(3):
        rows.where(f"row_id % 3 = {k} or row_id % 2 = {k % 2}").write.parquet(f"{source}/{k}")
        got = feed(spark, source, rows.schema, store, ckpt)
    once = sorted(tuple(r) for r in got.collect())
    assert {(r[0], r[1]) for r in once} == {(0, "after"), (1, "before"), (1, "after"), (2, "before"), (2, "after")}
    # the last batch is lost after it was written: its commit is taken back, so the stream runs it again
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(ckpt).getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.delete(jvm.Path(f"{ckpt}/commits/2"), False)
    assert sorted(tuple(r) for r in feed(spark, source, rows.schema, store, ckpt).collect()) == once


def test_ids_of_a_few_tokens_are_those_of_the_vocabulary(spark):
    from labelwise.operators.tokens import vocabulary, vocabulary_of

    tokens = spark.createDataFrame([(t,) for t in ["b", "a", None, "é", "b", "Z", "日", "a"]], "token string").repartition(3)
    whole = {r.token: r.id for r in vocabulary(tokens).collect()}
    wanted = ["é", "Z", "b", "missing"]
    assert {r.token: r.id for r in vocabulary_of(tokens, wanted).collect()} == {t: whole[t] for t in wanted if t in whole}
    assert vocabulary_of(tokens.where("false"), wanted).count() == 0


def test_subwords_are_those_of_the_tokenizer(spark, monkeypatch):
    from labelwise.operators import subwords as SW
    from labelwise.plans import catalog
    path = catalog.subword_file()
    tok = SW.load(path)
    texts = [None, "", "a", " ", "Ein längerer Satz, 漢字 und 🙂.", "<|endoftext|> hello", "word " * 50_000, "x" * 30_000, "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(2)
    got = {r.k: r for r in SW.subwords(df, "text", path, 7, "n", "first").collect()}
    assert len(got) == len(texts) and got[0].n is None and got[0].first is None
    for k, text in enumerate(texts[1:], 1):
        want = tok.encode(text, add_special_tokens=False).ids
        assert (got[k].n, got[k].first) == (len(want), want[:7])
    assert [len(c) for c in SW._chunks(["x" * SW.CHUNK, "y", "z", "w" * SW.CHUNK])] == [1, 2, 1]
    assert SW.subwords(df.where("false"), "text", path, 7).columns == ["k", "n_subwords", "input_ids"]
    assert SW.subwords(df.where("false"), "text", path, 7).count() == 0


def test_subword_queries_against_a_plain_loop(spark):
    from labelwise.operators import subwords as SW
    from labelwise.plans import catalog
    tok, sf = SW.load(catalog.subword_file()), SF["0.001"]
    prompts = {r.row_id: tok.encode(r.prompt, add_special_tokens=False).ids for r in catalog.prompt_rows(spark, sf).collect()}
    rows = catalog.QUERIES["subword_pad_truncate"](spark, sf).collect()
    assert len(rows) == len(prompts) and any(r.n_subwords > 256 for r in rows)
    for r in rows:
        ids = prompts[r.row_id]
        assert (r.n_subwords, r.n_kept) == (len(ids), min(len(ids), 256))
        assert r.input_ids == (ids + [0] * 256)[:256]
    want = {}
    for r in catalog.labeled(spark, sf, columns=("text",)).select("label", catalog.train_prompt(F.col("text"), F.col("label")).alias("p")).collect():
        want.setdefault(r.label, []).append(len(tok.encode(r.p, add_special_tokens=False).ids))
    got = catalog.QUERIES["truncated_label_audit_subwords"](spark, sf).collect()
    assert {r.label: (r.n_prompts, r.n_truncated, r.n_subwords, r.max_subwords) for r in got} == {
        k: (len(v), sum(n > 256 for n in v), sum(v), max(v)) for k, v in want.items()}
