"""Golden cases (FIXTURES.md section 4): inline rows with known answers."""

import pytest
from pyspark.sql import functions as F

from labelwise.functions.answers import encode_seq2seq_pred, encode_seq2seq_truth, parse_answer
from labelwise.functions.keys import run_key
from labelwise.functions.prompts import TEST_HEAD, train_prompt
from labelwise.functions.prompts import test_prompt as inference_prompt
from labelwise.functions.text import py_strip
from labelwise.operators import metrics as M
from labelwise.operators.splits import bootstrap_sample, eval_pool, fraction_sizes, stratified_split
from labelwise.operators.tokens import mask, pad_truncate, unmask
from labelwise.plans.sinks import append_metrics, read_metrics
from labelwise.sources.csv import read_labelled_csv, sentence_frame


def _csv(tmp_folder, name, data: bytes):
    import os
    d = os.path.join(tmp_folder, "data", "Golden")
    os.makedirs(d, exist_ok=True)
    p = os.path.join(d, name)
    with open(p, "wb") as f:
        f.write(data)
    return p


def test_na_tokens_and_kept_values(spark, tmp_folder):
    rows = [b"positive,None", b"positive,NA", b"positive,null", b'positive,""', b"positive,n/a", b"positive,nan",
            b"negative,none", b"negative, NA"]
    p = _csv(tmp_folder, "data.csv", b"\n".join(rows) + b"\n")
    df = read_labelled_csv(spark, p).orderBy("row_id")
    got = [r["text"] for r in df.collect()]
    assert got == [None] * 6 + ["none", " NA"]
    prompts = df.select(inference_prompt(F.col("text")).alias("p")).collect()
    assert prompts[0]["p"].endswith("[nan] =")


def test_invalid_bytes_lenient_strict(spark, tmp_folder):
    p = _csv(tmp_folder, "data.csv", b"positive,a\xffb\n")
    assert read_labelled_csv(spark, p).first()["text"] == "a�b"
    assert read_labelled_csv(spark, p, on_bad_bytes="quarantine").first()["bad_bytes"] is True
    with pytest.raises(Exception):
        read_labelled_csv(spark, p, on_bad_bytes="error", with_row_id=False).collect()


def test_quoting_header_missing_field(spark, tmp_folder):
    data = b'label,text\npositive,"a ""q"" b\nline2, c"\npositive\n'
    p = _csv(tmp_folder, "data.csv", data)
    rows = read_labelled_csv(spark, p).orderBy("row_id").collect()
    assert [(r["label"], r["text"]) for r in rows] == [("label", "text"), ("positive", 'a "q" b\nline2, c'),
                                                       ("positive", None)]
    assert rows[0]["dataset"] == "Golden"
    assert len({r["row_id"] for r in rows}) == 3


def test_row_ids_are_file_index_and_line(spark, tmp_folder):
    """row_id = file index (path order) * 2^33 + record number in the file, however files are packed into
    partitions (small partitions here pack several files per task)."""
    texts = {f"data-{k}.csv": [f"t{k}-{i}" for i in range(n)] for k, n in ((1, 5), (2, 1), (3, 7))}
    paths = []
    for name, ts in texts.items():
        body = "".join(f'positive,"{t}\nsecond line"\n' if i % 2 else f"negative,{t}\n" for i, t in enumerate(ts))
        paths.append(_csv(tmp_folder, name, body.encode()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        rows = read_labelled_csv(spark, paths).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {}
    for f, (name, ts) in enumerate(sorted(texts.items())):
        for i, t in enumerate(ts):
            want[(f << 33) + i] = t
    assert {r["row_id"]: r["text"].split("\n")[0] for r in rows} == want


def test_cycle_from_path(spark, tmp_folder):
    p = _csv(tmp_folder, "data-2.csv", b"positive,x\n")
    assert read_labelled_csv(spark, p).first()["cycle"] == 2


def _frame(spark, labels):
    return spark.createDataFrame([(i, lab) for i, lab in enumerate(labels)], "row_id long, label string")


def test_padded_label_in_neither_class(spark):
    df = _frame(spark, ["positive"] * 3 + ["negative"] * 3 + [" positive"])
    a = stratified_split(df, 1, 1)
    assert a.where("label = ' positive'").count() == 0
    assert a.count() == 4


def test_three_labels_eval_policies(spark):
    df = _frame(spark, ["positive"] * 10 + ["negative"] * 10 + ["neutral"] * 10)
    a = stratified_split(df, 3, 2)
    ref = bootstrap_sample(eval_pool(df, a, policy="reference"), 4)
    strict = bootstrap_sample(eval_pool(df, a, policy="strict"), 4)
    assert ref.count() == 12 and strict.count() == 8
    assert ref.where("label = 'neutral'").count() == 4


def test_header_row_reaches_only_reference_eval(spark):
    df = _frame(spark, ["label"] + ["positive"] * 5 + ["negative"] * 5)
    a = stratified_split(df, 2, 1)
    assert a.where("label = 'label'").count() == 0
    assert eval_pool(df, a, policy="reference").where("label = 'label'").count() == 1
    assert eval_pool(df, a, policy="strict").where("label = 'label'").count() == 0


def test_class_too_small_names_class(spark):
    df = _frame(spark, ["positive"] * 10 + ["negative"] * 3)
    with pytest.raises(ValueError, match="negative"):
        stratified_split(df, 3, 2)


def test_eval_larger_than_pool_repeats(spark):
    pool = _frame(spark, ["positive", "positive"])
    rows = bootstrap_sample(pool, 5).collect()
    assert len(rows) == 5 and len({r["row_id"] for r in rows}) <= 2


def test_fraction_sizes():
    assert fraction_sizes(10) == {"train": 8, "eval": 1, "test": 1}
    assert fraction_sizes(100) == {"train": 80, "eval": 10, "test": 10}
    assert fraction_sizes(101) == {"train": 80, "eval": 10, "test": 11}


@pytest.mark.parametrize("raw,lenient,strict", [
    ("x] = Positive", "positive", "none"),
    ("= negative positive", "positive", "positive"),
    ("a=b=NEGATIVE", "negative", "none"),
    ("no equals sign, negative", "negative", "negative"),
    ("", "none", "none"),
])
def test_answer_parse(spark, raw, lenient, strict):
    df = spark.createDataFrame([(raw,)], "raw string")
    r = df.select(parse_answer(F.col("raw")).alias("a"), parse_answer(F.col("raw"), True).alias("b")).first()
    assert (r["a"], r["b"]) == (lenient, strict)


def test_unparsed_answer_policies(spark):
    df = spark.createDataFrame([("negative", "none")], "label string, pred string")
    wide = M.binary_eval(df).first()
    assert wide["accuracy"] == 0.0           # 'none' counted as predicted positive
    codes = df.select(encode_seq2seq_truth(F.col("label")).alias("y_true"),
                      encode_seq2seq_pred(F.col("pred")).alias("y_pred")).first()
    assert (codes["y_true"], codes["y_pred"]) == ("0", "-100")


def test_unknown_truth_fails(spark):
    df = spark.createDataFrame([("neutral",)], "label string")
    with pytest.raises(Exception, match="unknown label"):
        df.select(encode_seq2seq_truth(F.col("label"))).collect()


def test_unicode_strip(spark):
    df = spark.createDataFrame([("　  positive\n　",)], "s string")
    assert df.select(py_strip(F.col("s")).alias("s")).first()["s"] == "positive"


def test_pad_truncate_mask_roundtrip(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([5, 0],)], "a array<int>")
    r = df.select(pad_truncate(F.col("a"), 5).alias("p5"), pad_truncate(F.col("a"), 2).alias("p2"),
                  mask(F.col("a")).alias("m"), unmask(mask(F.col("a"))).alias("u")).collect()
    assert r[0]["p5"] == [1, 2, 3, 0, 0] and r[0]["p2"] == [1, 2]
    assert r[1]["m"] == [5, -100] and r[1]["u"] == [5, 0]


def test_one_class_only_and_empty(spark):
    df = spark.createDataFrame([("positive", "positive")] * 3, "label string, pred string")
    r = M.binary_eval(df).first()
    assert r["f1_0"] is None and r["f1_1"] == 1.0 and r["accuracy"] == 1.0
    empty = spark.createDataFrame([], "label string, pred string")
    assert M.binary_eval(empty, by=["label"]).count() == 0


def test_metrics_log_two_phases(spark, tmp_folder):
    from labelwise.plans.sinks import METRICS_SCHEMA
    rows = [("r", "d", "m", "eval", p, f"{p}_eval_accuracy", v) for p, v in (("before", 1 / 3), ("after", 0.75))]
    for r in rows:
        append_metrics(spark.createDataFrame([r], METRICS_SCHEMA), tmp_folder + "/m")
    assert sorted(tuple(x) for x in read_metrics(spark, tmp_folder + "/m").collect()) == sorted(rows)


def test_run_key(spark):
    df = spark.createDataFrame([("data/WeiboSentiment/data.csv", "Qwen/Qwen2-1.5B-Instruct")], "f string, m string")
    assert df.select(run_key(F.col("f"), F.col("m")).alias("k")).first()["k"] == "WeiboSentiment-Qwen2-1.5B-Instruct"


def test_single_sentence_prompt(spark):
    s = "如果是在国外：处罚小米恶意营销带来网络效应，罚款1000万？国内处理就随随便便找个个人顶包完事了"
    p = sentence_frame(spark, [s]).select(inference_prompt(F.col("text")).alias("p")).first()["p"]
    assert p == TEST_HEAD + s + "] ="
    assert p.startswith("Analyze the sentiment") and "\n            [" in p


def test_train_prompt_strips_blank_label(spark):
    df = spark.createDataFrame([("t", " 　")], "text string, label string")
    p = df.select(train_prompt(F.col("text"), F.col("label")).alias("p")).first()["p"]
    assert p.startswith("generate_prompt\n") and p.endswith("[t] =")


def test_train_prompt_equals_python_rstrip(spark):
    """The label-only strip equals Python's right-strip of the whole rendered f-string."""
    from labelwise.functions.prompts import TRAIN_HEAD
    texts = ["t", "t  ", " ", "", None, "a　", "x\n"]
    labels = ["positive", "pos ", "", "  ", "　 ", None, "a b\n", "\t"]
    rows = [(t, lab) for t in texts for lab in labels]
    df = spark.createDataFrame(rows, "text string, label string")
    got = [r["p"] for r in df.select(train_prompt(F.col("text"), F.col("label")).alias("p")).collect()]
    want = [f"{TRAIN_HEAD}{'nan' if t is None else t}] = {'nan' if lab is None else lab}".rstrip()
            for t, lab in rows]
    assert got == want


def test_adhoc_first_sentence_and_empty(spark):
    import pandas as pd

    from labelwise.plans.adhoc import predict_first, predict_sentences

    def make():
        return lambda words: pd.Series(["negative" if any("罚款" in w for w in ws) else "positive" for ws in words],
                                       index=words.index)

    s = "如果是在国外：处罚小米恶意营销带来网络效应，罚款1000万？国内处理就随随便便找个个人顶包完事了"
    assert predict_first(spark, [s, "fine"], make) == "negative"
    assert predict_first(spark, [], make) is None
    assert [r["pred"] for r in predict_sentences(spark, [s, "fine"], make).orderBy("idx").collect()] == \
        ["negative", "positive"]


def test_lr_model_roundtrip(spark, tmp_folder):
    from labelwise.operators.ml import lr_fit, lr_load, lr_predict, lr_save
    rows = [(i, "positive" if i % 2 else "negative", ("good fine" if i % 2 else "bad awful") + f" w{i}")
            for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, label string, text string")
    model = lr_fit(df)
    lr_save(model, tmp_folder + "/lr")
    again = lr_predict(lr_load(tmp_folder + "/lr"), df)
    assert again.where("pred = label").count() == 40


def test_nb_scores_rows_without_words(spark):
    """Naive Bayes by hand on a tiny corpus; rows with no known word, no word at all or NULL text still get
    a row (the prior), for the single model and for keyed models."""
    import math
    from labelwise.operators import naive_bayes as NB
    train = spark.createDataFrame([(1, "positive", "good good fun"), (2, "positive", "fun"),
                                   (3, "negative", "bad"), (4, "neutral", "ignored words")],
                                  "row_id long, label string, text string")
    model = NB.fit(NB.token_counts(train))
    assert model.vocab_size == 3 and model.vocab_bytes == len("good") + len("fun") + len("bad")
    docs = spark.createDataFrame([(10, "good bad"), (11, "unknown"), (12, ""), (13, None), (14, "!!")],
                                 "row_id long, text string")
    got = {r["row_id"]: (r["pred"], r["score_positive"], r["score_negative"])
           for r in NB.predict(model, docs).collect()}
    # positive: counts good 2, fun 2 (total 4); negative: bad 1 (total 1); V = 3; priors 2/3 and 1/3
    lp, ln_ = math.log(2 / 3), math.log(1 / 3)
    pos = lp + math.log(3 / 7) + math.log(1 / 7)
    neg = ln_ + math.log(1 / 4) + math.log(2 / 4)
    assert got[10] == ("positive" if pos >= neg else "negative", pytest.approx(pos), pytest.approx(neg))
    for rid in (11, 12, 13, 14):
        assert got[rid] == ("positive", pytest.approx(lp), pytest.approx(ln_))

    keyed = NB.keyed_token_counts(train.withColumn("m", F.lit(0)), "m")
    params = NB.keyed_params(keyed, "m")
    kdocs = docs.withColumn("m", F.lit(0))
    kgot = {r["row_id"]: (r["pred"], r["score_positive"], r["score_negative"])
            for r in NB.keyed_predict(keyed, params, kdocs, "m", params_rows=1).collect()}
    assert kgot == {k: (p, pytest.approx(a), pytest.approx(b)) for k, (p, a, b) in got.items()}


def test_ragged_rows_fail_or_are_flagged(spark, tmp_folder):
    p = _csv(tmp_folder, "data.csv", b'positive,hello,extra1\n"positive","x","y","z"\nnegative,fine\npositive,a,\npositive\n')
    with pytest.raises(Exception, match="more than two fields"):
        read_labelled_csv(spark, p).collect()
    rows = read_labelled_csv(spark, p, on_ragged="flag").orderBy("row_id").collect()
    assert [(r["text"], r["ragged"]) for r in rows] == [("hello", True), ("x", True), ("fine", False), ("a", False), (None, False)]   # an empty surplus field holds nothing


@pytest.mark.parametrize("path,dataset,cycle", [
    ("testdata/foo/data/quality/data.csv", "quality", None), ("data/a/data/b/data-3.csv", "b", 3),
    ("data/b/mydata-7.csv", "b", None), ("data/b/data-12/part.csv", "b", 12), ("mydata/x/y.csv", None, None)])
def test_dataset_and_cycle_of_a_path(spark, tmp_folder, path, dataset, cycle):
    import os
    full = os.path.join(tmp_folder, "root", path)
    os.makedirs(os.path.dirname(full))
    with open(full, "w") as f:
        f.write("positive,x\n")
    row = read_labelled_csv(spark, full).first()
    assert (row["dataset"], row["cycle"]) == (dataset, cycle)


def test_first_field_of_a_tuple(spark):
    from labelwise.functions.answers import first_field
    df = spark.createDataFrame([(("positive", 0.5), "negative")], "output struct<answer:string,score:double>, plain string")
    assert tuple(df.select(first_field(df, "output"), first_field(df, "plain")).first()) == ("positive", "negative")


def test_metrics_keep_full_values(spark):
    df = spark.createDataFrame([("positive", "positive")] * 2 + [("negative", "positive")], "label string, pred string")
    wide = M.binary_eval(df)
    assert wide.first()["accuracy"] == 2 / 3
    assert M.display(wide, 4).first()["accuracy"] == 0.6667 and M.display(wide, 5).first()["accuracy"] == 0.66667


def _small_splits(spark, size):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    return keep


@pytest.mark.parametrize("case", range(4))
def test_csv_in_small_splits_equals_pandas(spark, tmp_folder, case):
    """Quoted line breaks, doubled quotes, CRLF and empty lines, read in splits much smaller than a record."""
    import random

    import pandas as pd

    rng, pieces = random.Random(case), ["a", "bb ccc", '"', '""', ",", "\n", "\r\n", "é", "日本", "\n\n", "x,y", '"q"', '= ["']
    end, body = ("\r\n" if case == 1 else "\n"), ""
    for _ in range(300):
        text = "".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 3, 10, 80])))
        quote = case == 2 or any(c in text for c in ',"\n\r')
        body += rng.choice(["positive", "negative", "other"]) + "," + ('"' + text.replace('"', '""') + '"' if quote else text) + end
        body += end if rng.random() < 0.05 else ""
    p = _csv(tmp_folder, "data.csv", body.encode() if case != 3 else body.rstrip("\n").encode())
    want = pd.read_csv(p, header=None, names=["label", "text"])
    keep = _small_splits(spark, "200b")
    try:
        df = read_labelled_csv(spark, p)
        got = df.orderBy("row_id").collect()
        assert spark.read.text(p).rdd.getNumPartitions() > 50
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert [(r.label, r.text) for r in got] == [(a, None if isinstance(b, float) else b) for a, b in zip(want.label, want.text)]
    assert [r.row_id for r in got] == list(range(300))


def test_csv_strict_reading_looks_at_bytes(spark, tmp_folder):
    p = _csv(tmp_folder, "data.csv", "positive,ok \ufffd here\n".encode() + b'negative,"two\nlines \xe2\x82"\npositive,fine\n')
    rows = read_labelled_csv(spark, p, on_bad_bytes="quarantine").orderBy("row_id").collect()
    assert [(r.text, r.bad_bytes) for r in rows] == [("ok \ufffd here", False), ("two\nlines \ufffd", True), ("fine", False)]
    with pytest.raises(Exception, match="invalid UTF-8 in record 2 of"):
        read_labelled_csv(spark, p, on_bad_bytes="error").collect()
    good = _csv(tmp_folder, "data-2.csv", "positive,ok \ufffd here\n".encode())
    assert read_labelled_csv(spark, good, on_bad_bytes="error").count() == 1


def test_csv_of_nothing(spark, tmp_folder):
    assert read_labelled_csv(spark, _csv(tmp_folder, "data.csv", b"")).count() == 0
    assert read_labelled_csv(spark, _csv(tmp_folder, "data-1.csv", b"\n\r\n\n")).count() == 0
