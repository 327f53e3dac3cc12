"""Registry of named queries (Spark) and their independent SQL oracles.

Every query reads the driver's Parquet tables (or data Spark derives from them) in full.
Split sizes for registered queries are 30 / 20 / 20 rows per class (the smallest class at sf0.01 has 58).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.answers import CLASSES, encode_binary, encode_seq2seq_pred, encode_seq2seq_truth, first_field, parse_answer
from ..functions.keys import dataset_path, run_key
from ..operators import metrics as M
from . import sql_fragments as S
from ..operators.splits import (APPROX_PARTS, eval_pool, fraction_bounds, fraction_split, fraction_split_approx, fraction_spread,
                                shuffle_positions, stratified_split)
from ..operators.tokens import (IGNORE_ID, decode, effective_length, explode_tokens, mask, pad_to_longest,
                               pad_truncate, token_count, token_ids, unmask, vocabulary, vocabulary_of)
from ..functions.prompts import test_prompt, train_prompt
from ..session import cut_lineage, scratch_folder
from ..operators import naive_bayes as NB
from ..operators import subwords as SW
from ..operators.linear import BUCKETS, STEPS, fit_linear, hashed_words, predict_linear
from ..operators.scoring import nb_answers
from ..sources.tables import attach_text, labeled, labeled_keys, multi_task, read_table, unlabelled
from ..sources.layout import laid_out
from ..sources.csv import read_labelled_csv, write_labelled_csv
from .sinks import (append_metrics, load_counts, load_version, log_metrics, publish_version, published_version, read_log, read_metrics,
                    save_counts, save_version, write_splits)
from ..streaming.cycles import cycle_eval, cycle_models, stream_confusion, stream_counts, test_then_train, write_batches
from .dataset import (Sizes, assignment, bundle, bundle_keys, counted_keys, eval_set, fraction_set, fraction_set_approx, full_train,
                      grid_assignment, leak_audit, test_set, train_set)
from .fixtures import fixture_raw

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SIZES = Sizes(30, 20, 20)
DIGITS = 6   # rounding of ratios in the registered queries, so engines agree; the operators return full values


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _with(*ctes: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in ctes) + "\n"


_LAB = ("labeled", S.labeled())
_ASSIGN = ("assign", S.assign(SIZES.train, SIZES.test))
_TEST = ("test", f"SELECT row_id, label, rank, (CASE WHEN label = 'positive' THEN 0 ELSE 1 END) * {SIZES.test} "
                 f"+ rank - {SIZES.train} - 1 AS ord, {S.test_prompt()} AS prompt FROM assign WHERE split = 'test'")
_RUNS = ("runs", S.fixture_runs("test"))
_PARSED = ("parsed", f"SELECT row_id, label, phase, answer, raw, {S.parse()} AS pred FROM runs")


# ---- step 1: split -> prompts -> parse -> evaluate --------------------------------------------------------

@register("split_stratified", _with(_LAB, _ASSIGN) + "SELECT row_id, label, split, rank FROM assign")
def q_split_stratified(spark, sf_dir):
    return assignment(spark, sf_dir, SIZES)


@register("prompt_test", _with(_LAB, _ASSIGN, _TEST) + "SELECT row_id, label, rank, ord, prompt FROM test")
def q_prompt_test(spark, sf_dir):
    return test_set(spark, sf_dir, SIZES)


def parsed_runs(spark: SparkSession, sf_dir: str, sizes: Sizes = SIZES, case_sensitive: bool = False) -> DataFrame:
    runs = fixture_raw(test_set(spark, sf_dir, sizes))
    return runs.withColumn("pred", parse_answer(F.col("raw"), case_sensitive))


@register("parse_answer", _with(_LAB, _ASSIGN, _TEST, _RUNS, _PARSED)
          + "SELECT row_id, phase, answer, pred FROM parsed")
def q_parse_answer(spark, sf_dir):
    return parsed_runs(spark, sf_dir).select("row_id", "phase", "answer", "pred")


@register("eval_binary", _with(_LAB, _ASSIGN, _TEST, _RUNS, _PARSED) + S.binary_eval("parsed"))
def q_eval_binary(spark, sf_dir):
    return M.display(M.binary_eval(parsed_runs(spark, sf_dir), "label", "pred", by=["phase"]), DIGITS)


# ---- step 2: dataset building ------------------------------------------------------------------------------

_TRAIN = ("train", f"SELECT row_id, label, row_number() OVER (ORDER BY {S.key(10, 'row_id')}, row_id) - 1 AS ord, "
                   f"{S.train_prompt()} AS prompt FROM assign WHERE split = 'train'")
_POOL_STRICT = ("pool", "SELECT row_id, label FROM labeled WHERE label IN ('positive', 'negative') "
                        "AND row_id NOT IN (SELECT row_id FROM assign)")
_POOL_REF = ("pool", "SELECT row_id, label FROM labeled WHERE label IS NOT NULL "
                     "AND row_id NOT IN (SELECT row_id FROM assign WHERE label = 'negative')")


def _bootstrap_sql(n: int) -> list[tuple[str, str]]:
    draw_key = "md5('10:' || label || ':' || CAST(j AS VARCHAR))"
    return [
        ("ranked", f"SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {S.key(10, 'row_id')}, "
                   f"row_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS pool_n FROM pool"),
        ("draws", f"SELECT label, j AS draw, {S.hex15(draw_key)} % pool_n AS idx "
                  f"FROM (SELECT DISTINCT label, pool_n FROM ranked) s, range(1, {n + 1}) t(j)"),
        ("picked", "SELECT d.label, d.draw, r.row_id FROM draws d JOIN ranked r ON r.label = d.label AND r.pos = d.idx"),
        ("evalset", f"SELECT p.row_id, p.label, p.draw, (dense_rank() OVER (ORDER BY p.label) - 1) * {n} + p.draw - 1 "
                    f"AS ord, {S.train_prompt('l.text', 'p.label')} AS prompt FROM picked p "
                    f"JOIN labeled l ON l.row_id = p.row_id"),
    ]


@register("prompt_train", _with(_LAB, _ASSIGN, _TRAIN) + "SELECT row_id, label, ord, prompt FROM train")
def q_prompt_train(spark, sf_dir):
    return train_set(spark, sf_dir, SIZES)


@register("train_shuffled", _with(_LAB, _ASSIGN, _TRAIN) + "SELECT row_id, label, ord FROM train")
def q_train_shuffled(spark, sf_dir):
    return shuffle_positions(assignment(spark, sf_dir, SIZES).where(F.col("split") == "train")
                             .select("row_id", "label"))


@register("eval_pool_strict", _with(_LAB, _ASSIGN, _POOL_STRICT) + "SELECT row_id, label FROM pool")
def q_eval_pool_strict(spark, sf_dir):
    return eval_pool(labeled_keys(spark, sf_dir), assignment(spark, sf_dir, SIZES), policy="strict",
                     bound_rows=SIZES.split_rows)


@register("eval_pool_reference", _with(_LAB, _ASSIGN, _POOL_REF) + "SELECT row_id, label FROM pool")
def q_eval_pool_reference(spark, sf_dir):
    return eval_pool(labeled_keys(spark, sf_dir), assignment(spark, sf_dir, SIZES), policy="reference",
                     bound_rows=SIZES.split_rows)


@register("eval_bootstrap", _with(_LAB, _ASSIGN, _POOL_STRICT, *_bootstrap_sql(SIZES.eval))
          + "SELECT row_id, label, draw, ord, prompt FROM evalset")
def q_eval_bootstrap(spark, sf_dir):
    return eval_set(spark, sf_dir, SIZES, policy="strict")


@register("eval_bootstrap_reference", _with(_LAB, _ASSIGN, _POOL_REF, *_bootstrap_sql(SIZES.eval))
          + "SELECT row_id, label, draw, ord, prompt FROM evalset")
def q_eval_bootstrap_reference(spark, sf_dir):
    return eval_set(spark, sf_dir, SIZES, policy="reference")


_FRACTION = [
    ("sz", "SELECT count(*) AS n, CAST(ceil((1.0::DOUBLE - 0.8::DOUBLE) * count(*)) AS BIGINT) AS n_temp FROM labeled"),
    ("sz2", "SELECT n - n_temp AS n_train, n_temp - CAST(ceil(0.5::DOUBLE * n_temp) AS BIGINT) AS n_eval FROM sz"),
    ("fpos", f"SELECT row_id, label, text, row_number() OVER (ORDER BY {S.key(42, 'row_id')}, row_id) - 1 AS pos "
             f"FROM labeled"),
    ("frac", "SELECT row_id, label, text, pos, CASE WHEN pos < n_train THEN 'train' WHEN pos < n_train + n_eval "
             "THEN 'eval' ELSE 'test' END AS split FROM fpos, sz2"),
]


@register("split_fraction", _with(_LAB, *_FRACTION)
          + f"SELECT row_id, label, pos, split, CASE WHEN split = 'train' THEN {S.train_prompt()} "
            f"ELSE {S.test_prompt()} END AS prompt FROM frac")
def q_split_fraction(spark, sf_dir):
    return fraction_set(spark, sf_dir)


_APPROX = ("approx", f"SELECT row_id, label, text, CASE WHEN h < {fraction_bounds()[0]} THEN 'train' WHEN h < {fraction_bounds()[1]} "
                     f"THEN 'eval' ELSE 'test' END AS split FROM (SELECT *, {S.hex15(S.key(42, 'row_id'))} % {APPROX_PARTS} AS h FROM labeled) x")


@register("split_fraction_approx", _with(_LAB, _APPROX)
          + f"SELECT row_id, label, split, CASE WHEN split = 'train' THEN {S.train_prompt()} ELSE {S.test_prompt()} END AS prompt FROM approx")
def q_split_fraction_approx(spark, sf_dir):
    return fraction_set_approx(spark, sf_dir)


@register("split_fraction_spread", _with(_LAB, _APPROX, ("shares", f"SELECT * FROM (VALUES ('train', {fraction_bounds()[0]}), "
          f"('eval', {fraction_bounds()[1] - fraction_bounds()[0]}), ('test', {APPROX_PARTS - fraction_bounds()[1]})) v(split, parts)"),
          ("sized", f"SELECT s.split, parts::DOUBLE / {APPROX_PARTS} AS p, count(a.row_id) AS n, (SELECT count(*) FROM approx)::DOUBLE AS total "
                    "FROM shares s LEFT JOIN approx a ON a.split = s.split GROUP BY s.split, parts"))
          + "SELECT split, n, round(total * p, 6) AS expected, round((n - total * p) / sqrt(total * p * (1 - p)), 6) AS deviations FROM sized")
def q_split_fraction_spread(spark, sf_dir):
    """Sizes of the approximate split of all labelled rows against their binomial spread."""
    return M.display(fraction_spread(fraction_split_approx(labeled_keys(spark, sf_dir))), DIGITS)


@register("full_train_set", _with(_LAB) + f"SELECT row_id, label, row_number() OVER (ORDER BY {S.key(10, 'row_id')}, "
                                         f"row_id) - 1 AS ord, {S.train_prompt()} AS prompt FROM labeled")
def q_full_train_set(spark, sf_dir):
    return full_train(spark, sf_dir)


@register("split_leak_audit", _with(_LAB, *_FRACTION)
          + "SELECT md5(text) AS text_md5, count(DISTINCT split) AS n_splits, count(*) AS n_rows, "
            "string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM frac GROUP BY md5(text) "
            "HAVING count(DISTINCT split) > 1")
def q_split_leak_audit(spark, sf_dir):
    keys, n = counted_keys(spark, sf_dir)
    return leak_audit(fraction_split(keys, n=n), spark, sf_dir, bound_rows=n)


_BUNDLE = [_LAB, _ASSIGN, _TRAIN, _TEST, _POOL_STRICT, *_bootstrap_sql(SIZES.eval),
           ("bundle", "SELECT 'train' AS split, row_id, label, ord, prompt FROM train UNION ALL "
                      "SELECT 'test', row_id, label, ord, prompt FROM test UNION ALL "
                      "SELECT 'eval', row_id, label, ord, prompt FROM evalset")]


@register("split_sizes", _with(*_BUNDLE) + "SELECT split, label, count(*) AS n FROM bundle GROUP BY split, label")
def q_split_sizes(spark, sf_dir):
    keys, _ = bundle_keys(spark, sf_dir, SIZES)
    return keys.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@register("split_preview", _with(*_BUNDLE)
          + "SELECT split, count(*) AS n, arg_min(prompt, ord) AS first_prompt FROM bundle GROUP BY split")
def q_split_preview(spark, sf_dir):
    return (bundle(spark, sf_dir, SIZES).groupBy("split")
            .agg(F.count(F.lit(1)).alias("n"), F.min_by("prompt", "ord").alias("first_prompt")))


# ---- step 3: evaluation ------------------------------------------------------------------------------------

FIXTURE_MODEL = "labelwise/fixture-answers"   # model name recorded for the deterministic stand-in outputs
_PARSED_CS = ("parsed", f"SELECT row_id, label, phase, answer, raw, {S.parse(case_sensitive=True)} AS pred FROM runs")
_ENC = ("enc", f"SELECT row_id, phase, {S.encode('label')} AS y_true, {S.encode('pred')} AS y_pred FROM parsed")
_CONF = ("conf", "SELECT phase, y_true, y_pred, count(*) AS n FROM enc GROUP BY phase, y_true, y_pred")
_WIDE = ("wide", S.binary_eval("parsed", digits=None))


def _strip_sql(c: str) -> str:
    from ..functions.text import LSTRIP_PATTERN, RSTRIP_PATTERN
    from ..functions.prompts import sql_literal
    return (f"regexp_replace(regexp_replace({c}, {sql_literal(RSTRIP_PATTERN)}, ''), "
            f"{sql_literal(LSTRIP_PATTERN)}, '')")


def _eval_wide(spark, sf_dir):
    return M.binary_eval(parsed_runs(spark, sf_dir), "label", "pred", by=["phase"])


@register("parse_answer_case_sensitive", _with(_LAB, _ASSIGN, _TEST, _RUNS, _PARSED_CS)
          + "SELECT row_id, phase, answer, pred FROM parsed")
def q_parse_answer_cs(spark, sf_dir):
    return parsed_runs(spark, sf_dir, case_sensitive=True).select("row_id", "phase", "answer", "pred")


@register("encode_labels", _with(_LAB, _ASSIGN, _TEST, _RUNS, _PARSED, _ENC) + "SELECT * FROM enc")
def q_encode_labels(spark, sf_dir):
    return parsed_runs(spark, sf_dir).select("row_id", "phase", encode_binary(F.col("label")).alias("y_true"),
                                             encode_binary(F.col("pred")).alias("y_pred"))


@register("confusion_counts", _with(_LAB, _ASSIGN, _TEST, _RUNS, _PARSED, _ENC, _CONF) + "SELECT * FROM conf")
def q_confusion_counts(spark, sf_dir):
    return M.confusion(q_encode_labels(spark, sf_dir), by=["phase"])


@register("class_report", _with(_LAB, _ASSIGN, _TEST, _RUNS, _PARSED, _ENC, _CONF, ("st", S.class_stats("conf", "phase")))
          + f"SELECT phase, cls, round({S.ratio('tp', 'pp')}, 6) AS precision, "
            f"round({S.ratio('tp', 'support')}, 6) AS recall, round({S.ratio('2 * tp', 'pp + support')}, 6) AS f1, "
            f"CAST(support AS BIGINT) AS support FROM st")
def q_class_report(spark, sf_dir):
    return M.display(M.class_report(M.confusion(q_encode_labels(spark, sf_dir), by=["phase"]), by=["phase"]), DIGITS)


_CODES = ("codes", f"SELECT phase, CASE WHEN {_strip_sql('label')} = 'negative' THEN '0' "
                   f"WHEN {_strip_sql('label')} = 'positive' THEN '1' ELSE error('unknown label: ' || label) END AS y_true, "
                   f"CASE WHEN {_strip_sql('answer')} = 'negative' THEN '0' WHEN {_strip_sql('answer')} = 'positive' "
                   f"THEN '1' ELSE '-100' END AS y_pred FROM runs")
_CODES_CONF = ("cconf", "SELECT phase, y_true, y_pred, count(*) AS n FROM codes GROUP BY phase, y_true, y_pred")


@register("eval_seq2seq", _with(_LAB, _ASSIGN, _TEST, _RUNS, _CODES, _CODES_CONF)
          + f"SELECT phase, accuracy, f1_weighted AS f1 FROM ({S.summary(S.class_stats('cconf', 'phase'), 'phase', ())})")
def q_eval_seq2seq(spark, sf_dir):
    # the output of a sequence model is a tuple: its predictions come first
    runs = fixture_raw(test_set(spark, sf_dir, SIZES)).withColumn("output", F.struct("answer", "raw"))
    codes = runs.select("phase", encode_seq2seq_truth(F.col("label")).alias("y_true"),
                        encode_seq2seq_pred(first_field(runs, "output")).alias("y_pred"))
    return M.display(M.seq2seq_eval(codes, by=["phase"]), DIGITS)


_METRIC_COLS = (("eval_accuracy", "accuracy"), ("f1_score_0", "f1_0"), ("f1_score_1", "f1_1"),
                ("f1_score_macro", "f1_macro"), ("f1_score_weighted", "f1_weighted"))


@register("eval_before_after", _with(_LAB, _ASSIGN, _TEST, _RUNS, _PARSED, _WIDE)
          + "SELECT metric, round(max(CASE WHEN phase = 'before' THEN v END), 6) AS before, "
            "round(max(CASE WHEN phase = 'after' THEN v END), 6) AS after, "
            "round(max(CASE WHEN phase = 'after' THEN v END) - max(CASE WHEN phase = 'before' THEN v END), 6) AS delta "
            "FROM (" + " UNION ALL ".join(f"SELECT phase, '{w}' AS metric, {w} AS v FROM wide" for _, w in _METRIC_COLS)
          + ") u GROUP BY metric")
def q_eval_before_after(spark, sf_dir):
    return M.display(M.before_after(_eval_wide(spark, sf_dir)), DIGITS)


_RUN_ID_SQL = (f"split_part('data/quality/data.csv', '/', 2) || '-' || split_part('{FIXTURE_MODEL}', '/', 2)")


@register("metrics_long", _with(_LAB, _ASSIGN, _TEST, _RUNS, _PARSED, _WIDE)
          + " UNION ALL ".join(f"SELECT {_RUN_ID_SQL} AS run_id, 'quality' AS dataset, '{FIXTURE_MODEL}' AS model, 'eval' AS split, "
                               f"phase, phase || '_{k}' AS metric, round({w}, 6) AS value FROM wide" for k, w in _METRIC_COLS))
def q_metrics_long(spark, sf_dir):
    return M.display(metrics_record(spark, sf_dir), DIGITS)


def metrics_record(spark, sf_dir):
    """The full values of both phases, one row per metric, as they are logged."""
    run_id = run_key(dataset_path(F.lit("quality")), F.lit(FIXTURE_MODEL))
    return M.metrics_long(_eval_wide(spark, sf_dir)).select(
        run_id.alias("run_id"), F.lit("quality").alias("dataset"), F.lit(FIXTURE_MODEL).alias("model"),
        F.lit("eval").alias("split"), "phase", "metric", "value")


@register("metrics_scalars", _with(_LAB, _ASSIGN, _TEST, _RUNS, _PARSED, _WIDE)
          + "SELECT phase, 'eval/accuracy' AS tag, round(accuracy, 6) AS value FROM wide UNION ALL "
            "SELECT phase, 'eval/f1', round(f1_macro, 6) FROM wide")
def q_metrics_scalars(spark, sf_dir):
    return M.display(M.scalars(_eval_wide(spark, sf_dir), by=["phase"]), DIGITS)


@register("metrics_display", _with(_LAB, _ASSIGN, _TEST, _RUNS, _PARSED, _WIDE)
          + "SELECT phase, 4 AS digits, " + ", ".join(f"round({w}, 4) AS {w}" for _, w in _METRIC_COLS) + " FROM wide UNION ALL "
            "SELECT phase, 5, " + ", ".join(f"round({w}, 5)" for _, w in _METRIC_COLS) + " FROM wide")
def q_metrics_display(spark, sf_dir):
    """The evaluation as reports show it, with 4 and with 5 digits."""
    wide = _eval_wide(spark, sf_dir)
    return (M.display(wide, 4).withColumn("digits", F.lit(4))
            .unionByName(M.display(wide, 5).withColumn("digits", F.lit(5))))


_MT = ("mt", f"SELECT 'quality' AS dataset, * FROM ({S.labeled('quality')}) a UNION ALL "
             f"SELECT 'toxic' AS dataset, * FROM ({S.labeled('toxic')}) b")
_GASSIGN = ("assign", S.assign(SIZES.train, SIZES.test, src="mt", part="dataset"))
_GTEST = ("test", f"SELECT dataset, row_id, label, text, {S.test_prompt()} AS prompt FROM assign WHERE split = 'test'")
_GPARSED = ("parsed", f"SELECT dataset, row_id, label, phase, {S.parse()} AS pred FROM runs")
PRIOR_MODEL, NB_MODEL = "labelwise/prior", "labelwise/naive-bayes"
_GNB = [
    ("gtok", f"SELECT dataset, label, unnest({S.tokens()}) AS token FROM assign WHERE split = 'train'"),
    ("gcounts", "SELECT dataset, token, count(*) FILTER (WHERE label = 'positive') AS n_positive, "
                "count(*) FILTER (WHERE label = 'negative') AS n_negative FROM gtok GROUP BY dataset, token"),
    ("gparams", "SELECT dataset, ln(tp + v) AS ld_positive, ln(tn + v) AS ld_negative, ln(dp / (dp + dn)) AS lp_positive, "
                "ln(dn / (dp + dn)) AS lp_negative FROM (SELECT dataset, sum(n_positive)::DOUBLE AS tp, sum(n_negative)::DOUBLE AS tn, "
                "count(*)::DOUBLE AS v FROM gcounts GROUP BY dataset) a JOIN (SELECT dataset, "
                "(count(*) FILTER (WHERE label = 'positive'))::DOUBLE AS dp, (count(*) FILTER (WHERE label = 'negative'))::DOUBLE AS dn "
                "FROM assign WHERE split = 'train' GROUP BY dataset) b USING (dataset)"),
    ("gdtok", f"SELECT dataset, row_id, unnest({S.tokens()}) AS token FROM test"),
    ("gsums", "SELECT dataset, row_id, count(*) AS n, sum(ln(n_positive + 1)) AS s_positive, sum(ln(n_negative + 1)) AS s_negative "
              "FROM gdtok JOIN gcounts USING (dataset, token) GROUP BY dataset, row_id"),
    ("gscored", "SELECT dataset, label, lp_positive, lp_negative, "
                "lp_positive + coalesce(s_positive, 0) - coalesce(n, 0) * ld_positive AS sp, "
                "lp_negative + coalesce(s_negative, 0) - coalesce(n, 0) * ld_negative AS sn "
                "FROM test JOIN gparams USING (dataset) LEFT JOIN gsums USING (dataset, row_id)"),
    ("gpreds", f"SELECT '{FIXTURE_MODEL}' AS model, dataset, phase, label, pred FROM parsed UNION ALL "
               f"SELECT '{PRIOR_MODEL}', dataset, 'before', label, CASE WHEN lp_positive >= lp_negative THEN 'positive' "
               f"ELSE 'negative' END FROM gscored UNION ALL "
               f"SELECT '{NB_MODEL}', dataset, 'after', label, CASE WHEN sp >= sn THEN 'positive' ELSE 'negative' END FROM gscored"),
]


@register("eval_grid", _with(_MT, _GASSIGN, _GTEST, _RUNS, _GPARSED, *_GNB)
          + S.binary_eval("gpreds", by="model, dataset, phase"))
def q_eval_grid(spark, sf_dir):
    """Every model on every dataset: the stand-in answers (both phases), the class prior before and naive Bayes after
    training. All datasets are split, trained and scored in one job."""
    assign = grid_assignment(spark, sf_dir, SIZES)
    rows = attach_text(spark, sf_dir, assign, bound_rows=SIZES.split_rows * 2)
    test = rows.where(F.col("split") == "test")
    runs = fixture_raw(test.select("dataset", "row_id", "label", test_prompt(F.col("text")).alias("prompt")))
    fixed = runs.select(F.lit(FIXTURE_MODEL).alias("model"), "dataset", "phase", "label", parse_answer(F.col("raw")).alias("pred"))
    counts = cut_lineage(NB.keyed_token_counts(rows.where(F.col("split") == "train"), "dataset"), "grid-counts")
    params = NB.keyed_params(counts, "dataset")
    learnt = (NB.keyed_predict(counts, params, test.select("dataset", "row_id", "label", "text"), "dataset", params_rows=2, carry=("label",))
              .select(F.lit(NB_MODEL).alias("model"), "dataset", F.lit("after").alias("phase"), "label", "pred"))
    first, second = CLASSES
    majority = params.select("dataset", F.when(F.col(f"lp_{first}") >= F.col(f"lp_{second}"), first).otherwise(second).alias("pred"))
    prior = (assign.where(F.col("split") == "test").join(F.broadcast(majority), "dataset")      # one row per dataset
             .select(F.lit(PRIOR_MODEL).alias("model"), "dataset", F.lit("before").alias("phase"), "label", "pred"))
    return M.display(M.binary_eval(fixed.unionByName(prior).unionByName(learnt), "label", "pred", by=["model", "dataset", "phase"]), DIGITS)


@register("run_key", "SELECT DISTINCT 'data/' || lang || '/data.csv' AS filename, "
                     f"'{FIXTURE_MODEL}' AS model_name, lang || '-' || split_part('{FIXTURE_MODEL}', '/', 2) AS run_id "
                     "FROM documents")
def q_run_key(spark, sf_dir):
    from ..sources.tables import read_table
    docs = read_table(spark, sf_dir, "documents").select("lang").distinct()
    fn, model = dataset_path(F.col("lang")), F.lit(FIXTURE_MODEL)
    return docs.select(fn.alias("filename"), model.alias("model_name"), run_key(fn, model).alias("run_id"))


# ---- step 4: token arrays ----------------------------------------------------------------------------------

MAX_SEQ_LENGTH = 256      # requested max length
MODEL_MAX_LENGTH = 512    # the tokenizer's own limit; the effective length is the smaller
BATCH_SIZE = 8            # rows per training batch (label arrays are padded per batch)
_N_TOK = effective_length(MAX_SEQ_LENGTH, MODEL_MAX_LENGTH)


def corpus_vocab(spark, sf_dir):
    """Vocabulary over every document word plus the class names."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    names = explode_tokens(spark.createDataFrame([(i, c) for i, c in enumerate(CLASSES)], "row_id long, text string"))
    return vocabulary(explode_tokens(docs).select("token").unionByName(names.select("token")))


def prompt_rows(spark, sf_dir):
    """``(row_id, label, split, batch_id, prompt)`` of the fractional split: batches of ``BATCH_SIZE`` in the order of each split."""
    rows = fraction_set(spark, sf_dir)
    first = rows.groupBy("split").agg(F.min("pos").alias("_first"))                       # three rows
    return (rows.join(F.broadcast(first), "split")
            .select("row_id", "label", "split", ((F.col("pos") - F.col("_first")) / BATCH_SIZE).cast("long").alias("batch_id"), "prompt"))


def seq2seq_vocab(rows):
    """Vocabulary of all words of all prompts and of the class names (``vocabulary`` stores its distinct tokens)."""
    names = explode_tokens(rows.sparkSession.createDataFrame([(i, c) for i, c in enumerate(CLASSES)], "row_id long, text string"))
    words = explode_tokens(rows, "prompt")
    return vocabulary(words.select("token").unionByName(names.select("token")))


def class_vocab(rows):
    """The class names' part of ``seq2seq_vocab``, without numbering the other words."""
    names = rows.sparkSession.createDataFrame([(c,) for c in CLASSES], "token string")
    return cut_lineage(vocabulary_of(explode_tokens(rows, "prompt").select("token").unionByName(names), CLASSES), "class-vocabulary")


def input_arrays(rows, vocab):
    """``(row_id, input_ids)``: each prompt's first ``_N_TOK`` words, padded; a prompt without words is all padding."""
    ids = token_ids(explode_tokens(rows, "prompt", outer=True, max_pos=_N_TOK), vocab)
    return ids.select("row_id", pad_truncate(F.col("ids"), _N_TOK).alias("input_ids"))


def label_arrays(rows, vocab):
    """``(row_id, split, batch_id, labels)``: label ids padded to the longest of their batch."""
    names = rows.sparkSession.createDataFrame([(c, c) for c in CLASSES], "label string, text string")
    ids = token_ids(explode_tokens(names, id_col="label"), vocab, id_col="label")         # a row per class
    with_ids = rows.join(F.broadcast(ids), "label", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<long>")))
    padded = pad_to_longest(with_ids.withColumn("_batch", F.struct("split", "batch_id")), "ids", "_batch", out="labels")
    return padded.select("row_id", "split", "batch_id", "labels")


_DOC = ("doc", "SELECT doc_id AS row_id, text FROM documents")
_TOK = ("tok", f"SELECT row_id, unnest(toks) AS token, unnest(generate_series(1, len(toks))) AS pos "
               f"FROM (SELECT row_id, {S.tokens()} AS toks FROM doc)")
_NAMES = "SELECT unnest(['positive', 'negative']) AS token"
_VOCAB = ("vocab", f"SELECT token, row_number() OVER (ORDER BY token) AS id FROM (SELECT token FROM tok UNION {_NAMES}) u")
_PROMPTS = [_LAB, *_FRACTION,
            ("prow", f"SELECT row_id, label, split, (pos - min(pos) OVER (PARTITION BY split)) // {BATCH_SIZE} AS batch_id, "
                     f"CASE WHEN split = 'train' THEN {S.train_prompt()} ELSE {S.test_prompt()} END AS prompt FROM frac"),
            ("ptok", f"SELECT row_id, unnest(toks) AS token, unnest(generate_series(1, len(toks))) AS pos "
                     f"FROM (SELECT row_id, {S.tokens('prompt')} AS toks FROM prow)"),
            ("pvocab", f"SELECT token, row_number() OVER (ORDER BY token) AS id FROM (SELECT token FROM ptok UNION {_NAMES}) u"),
            ("pids", f"SELECT t.row_id, list(v.id ORDER BY t.pos) AS ids FROM ptok t JOIN pvocab v USING (token) "
                     f"WHERE t.pos <= {_N_TOK} GROUP BY t.row_id"),
            ("inputs", f"SELECT p.row_id, list_resize(coalesce(i.ids, []::BIGINT[]), {_N_TOK}, 0) AS input_ids "
                       f"FROM prow p LEFT JOIN pids i USING (row_id)"),
            ("padded", "SELECT p.row_id, p.split, p.batch_id, list_resize(CASE WHEN v.id IS NULL THEN []::BIGINT[] ELSE [v.id] END, "
                       "max(CASE WHEN v.id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.split, p.batch_id), 0) AS labels "
                       "FROM prow p LEFT JOIN pvocab v ON v.token = p.label"),
            ("masked", f"SELECT row_id, split, batch_id, list_transform(labels, lambda x: CASE WHEN x = 0 THEN {IGNORE_ID} ELSE x END) "
                       f"AS labels FROM padded")]


@register("vocabulary", _with(_DOC, _TOK, _VOCAB) + "SELECT token, id FROM vocab")
def q_vocabulary(spark, sf_dir):
    return corpus_vocab(spark, sf_dir)


@register("tokens_pad_truncate", _with(*_PROMPTS) + "SELECT row_id, input_ids FROM inputs")
def q_tokens_pad_truncate(spark, sf_dir):
    rows = prompt_rows(spark, sf_dir)
    return input_arrays(rows, seq2seq_vocab(rows))


@register("labels_pad_batch", _with(*_PROMPTS) + "SELECT row_id, split, batch_id, labels FROM padded")
def q_labels_pad_batch(spark, sf_dir):
    rows = prompt_rows(spark, sf_dir)
    return label_arrays(rows, class_vocab(rows))


@register("labels_mask", _with(*_PROMPTS) + "SELECT row_id, labels FROM masked")
def q_labels_mask(spark, sf_dir):
    return q_labels_pad_batch(spark, sf_dir).select("row_id", mask(F.col("labels")).alias("labels"))


@register("labels_unmask_decode", _with(_LAB) + "SELECT row_id, coalesce(label, '') AS decoded FROM labeled")
def q_labels_unmask_decode(spark, sf_dir):
    rows = prompt_rows(spark, sf_dir)
    vocab = class_vocab(rows)
    masked = label_arrays(rows, vocab).select("row_id", mask(F.col("labels")).alias("labels"))
    return decode(masked.select("row_id", unmask(F.col("labels")).alias("ids")), "ids", vocab)


@register("seq2seq_features", _with(*_PROMPTS) + "SELECT m.row_id, m.split, m.batch_id, i.input_ids, m.labels "
                                                "FROM masked m JOIN inputs i USING (row_id)")
def q_seq2seq_features(spark, sf_dir):
    """The batch map: every prompt's ids and its batch's masked label ids, in one row."""
    rows = prompt_rows(spark, sf_dir)
    vocab = seq2seq_vocab(rows)
    labels = label_arrays(rows, vocab).withColumn("labels", mask(F.col("labels")))
    return labels.join(input_arrays(rows, vocab), "row_id").select("row_id", "split", "batch_id", "input_ids", "labels")


@register("truncated_label_audit", _with(_LAB)
          + f"SELECT label, count(*) AS n_prompts, count(*) FILTER (WHERE len({S.tokens('p')}) > {MAX_SEQ_LENGTH}) "
            f"AS n_truncated, max(len({S.tokens('p')})) AS max_tokens FROM (SELECT label, {S.train_prompt()} AS p "
            f"FROM labeled) x GROUP BY label")
def q_truncated_label_audit(spark, sf_dir):
    # each whole prompt is tokenised once (projected), then counted and compared
    rows = labeled(spark, sf_dir, columns=("text",))
    counted = rows.select("label", token_count(train_prompt(F.col("text"), F.col("label"))).alias("_n"))
    return (counted.groupBy("label")
            .agg(F.count(F.lit(1)).alias("n_prompts"),
                 F.count(F.when(F.col("_n") > MAX_SEQ_LENGTH, True)).alias("n_truncated"),
                 F.max("_n").cast("long").alias("max_tokens")))


def subword_file() -> str:
    """The public byte-level BPE vocabulary that subword lengths are counted with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register("subword_pad_truncate")
def q_subword_pad_truncate(spark, sf_dir):
    """Every prompt of the fractional split in subwords: number of them, number kept, and the kept ids, padded (BPE is beyond SQL)."""
    rows = SW.subwords(prompt_rows(spark, sf_dir).select("row_id", "split", "prompt"), "prompt", subword_file(), _N_TOK)
    return rows.select("row_id", "split", "n_subwords", F.size("input_ids").alias("n_kept"),
                       pad_truncate(F.col("input_ids"), _N_TOK).alias("input_ids"))


@register("truncated_label_audit_subwords")
def q_truncated_label_audit_subwords(spark, sf_dir):
    """Training prompts by label whose label is cut off at ``MAX_SEQ_LENGTH`` subwords, one scan and one small aggregate."""
    rows = labeled(spark, sf_dir, columns=("text",))
    prompts = rows.select("label", train_prompt(F.col("text"), F.col("label")).alias("prompt"))
    counted = SW.subwords(prompts, "prompt", subword_file(), 0)
    return (counted.groupBy("label")
            .agg(F.count(F.lit(1)).alias("n_prompts"),
                 F.count(F.when(F.col("n_subwords") > MAX_SEQ_LENGTH, True)).alias("n_truncated"),
                 F.sum("n_subwords").alias("n_subwords"), F.max("n_subwords").alias("max_subwords")))


# ---- step 5: classifier and scoring ------------------------------------------------------------------------

def split_texts(spark, sf_dir, split: str):
    rows = assignment(spark, sf_dir, SIZES).where(F.col("split") == split).select("row_id", "label")
    return attach_text(spark, sf_dir, rows, bound_rows=SIZES.split_rows)


def nb_model(spark, sf_dir):
    return NB.fit(NB.token_counts(split_texts(spark, sf_dir, "train")))


def _nb_sql(src: str, ids: str, text: str = "text") -> list[tuple[str, str]]:
    """Scores of every row of ``src`` (id columns ``ids``) against the train-split count model."""
    return [
        ("dtok", f"SELECT {ids}, unnest({S.tokens(text)}) AS token FROM {src}"),
        ("sums", f"SELECT {ids}, count(*) AS n, sum(ln(c.n_positive + 1)) AS s_positive, "
                 f"sum(ln(c.n_negative + 1)) AS s_negative FROM dtok d JOIN counts c ON d.token = c.token "
                 f"GROUP BY {ids}"),
        ("scored", f"SELECT x.*, lp_positive + coalesce(s.s_positive, 0) - coalesce(s.n, 0) * ld_positive AS sp, "
                   f"lp_negative + coalesce(s.s_negative, 0) - coalesce(s.n, 0) * ld_negative AS sn "
                   f"FROM {src} x LEFT JOIN sums s USING ({ids}), params"),
    ]


_NB_FIT = [
    ("trainrows", "SELECT row_id, label, text FROM assign WHERE split = 'train'"),
    ("ttok", f"SELECT label, unnest({S.tokens()}) AS token FROM trainrows"),
    ("counts", "SELECT token, count(*) FILTER (WHERE label = 'positive') AS n_positive, "
               "count(*) FILTER (WHERE label = 'negative') AS n_negative FROM ttok GROUP BY token"),
    ("params", "SELECT ln(dp / (dp + dn)) AS lp_positive, ln(dn / (dp + dn)) AS lp_negative, "
               "ln(tp + v) AS ld_positive, ln(tn + v) AS ld_negative FROM (SELECT "
               "(SELECT count(*) FILTER (WHERE label = 'positive') FROM trainrows)::DOUBLE AS dp, "
               "(SELECT count(*) FILTER (WHERE label = 'negative') FROM trainrows)::DOUBLE AS dn, "
               "(SELECT sum(n_positive) FROM counts)::DOUBLE AS tp, "
               "(SELECT sum(n_negative) FROM counts)::DOUBLE AS tn, (SELECT count(*) FROM counts)::DOUBLE AS v) p"),
]
_NB_PRED = "CASE WHEN sp >= sn THEN 'positive' ELSE 'negative' END"


@register("nb_train_counts", _with(_LAB, _ASSIGN, *_NB_FIT)
          + "SELECT token, n_positive, n_negative FROM counts UNION ALL "
            "SELECT NULL, count(*) FILTER (WHERE label = 'positive'), count(*) FILTER (WHERE label = 'negative') "
            "FROM trainrows")
def q_nb_train_counts(spark, sf_dir):
    return NB.token_counts(split_texts(spark, sf_dir, "train"))


@register("nb_predict", _with(_LAB, _ASSIGN, *_NB_FIT, _DOC, *_nb_sql("doc", "row_id"))
          + f"SELECT row_id, {_NB_PRED} AS pred, round(sp, 4) AS score_positive, round(sn, 4) AS score_negative "
            f"FROM scored")
def q_nb_predict(spark, sf_dir):
    model = nb_model(spark, sf_dir)
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return M.display(NB.predict(model, docs), 4)


@register("nb_before_after", _with(_LAB, _ASSIGN, *_NB_FIT,
                                   ("testrows", "SELECT row_id, label, text FROM assign WHERE split = 'test'"),
                                   *_nb_sql("testrows", "row_id"),
                                   ("preds", "SELECT 'before' AS phase, label, CASE WHEN lp_positive >= lp_negative "
                                             "THEN 'positive' ELSE 'negative' END AS pred FROM scored, params UNION ALL "
                                             f"SELECT 'after', label, {_NB_PRED} FROM scored"))
          + S.binary_eval("preds"))
def q_nb_before_after(spark, sf_dir):
    model = nb_model(spark, sf_dir)
    # the label rides along; the prior's answer is a constant beside each prediction
    after = NB.predict(model, split_texts(spark, sf_dir, "test"), carry=("label",))
    runs = F.array(F.struct(F.lit("before").alias("phase"), F.lit(NB.prior_class(model)).alias("pred")),
                   F.struct(F.lit("after").alias("phase"), F.col("pred")))
    preds = after.select("label", F.explode(runs).alias("_r")).select("label", "_r.phase", "_r.pred")
    return M.display(M.binary_eval(preds, "label", "pred", by=["phase"]), DIGITS)


@register("score_map_in_pandas", _with(_LAB, _ASSIGN, *_NB_FIT,
                                       ("u", f"SELECT conv_id, turn, {S.test_prompt()} AS prompt FROM conversations"),
                                       *_nb_sql("u", "conv_id, turn", text="prompt"),
                                       ("ans", f"SELECT conv_id, turn, prompt, {_NB_PRED} AS answer FROM scored"))
          + "SELECT conv_id, turn, answer, " + S.parse("prompt || ' ' || answer") + " AS pred FROM ans")
def q_score_map_in_pandas(spark, sf_dir):
    model = nb_model(spark, sf_dir)
    prompts = unlabelled(spark, sf_dir).select("conv_id", "turn", test_prompt(F.col("text")).alias("prompt"))
    scored = nb_answers(spark, model, prompts, ["conv_id", "turn"])
    raw = F.concat(F.col("prompt"), F.lit(" "), F.col("answer"))
    return scored.select("conv_id", "turn", "answer", parse_answer(raw).alias("pred"))


def _linear_sql() -> list[tuple[str, str]]:
    """The perceptron steps of ``operators.linear``, one pair of tables a step."""
    words = f"SELECT row_id, unnest({S.tokens()}) AS token FROM frac"
    out = [("feats", f"SELECT row_id, {S.hex15('md5(token)')} % {BUCKETS} AS bucket FROM ({words}) GROUP BY ALL"),
           ("learn", "SELECT row_id, CASE WHEN label = 'positive' THEN 1 ELSE -1 END AS y FROM frac "
                     "WHERE split = 'train' AND label IN ('positive', 'negative')"),
           ("sides", "SELECT count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = -1) AS m FROM learn"),
           ("teach", "SELECT row_id, y, y * greatest(1, CASE WHEN y = 1 THEN m // greatest(p, 1) ELSE p // greatest(m, 1) END) AS f FROM learn, sides"),
           ("w0", "SELECT NULL::BIGINT AS bucket, 0::BIGINT AS w WHERE false")]
    for k in range(1, STEPS + 1):
        out += [(f"wrong{k}", f"SELECT t.row_id, t.f FROM teach t LEFT JOIN feats x USING (row_id) LEFT JOIN w{k - 1} w USING (bucket) "
                              "GROUP BY t.row_id, t.y, t.f HAVING t.y * coalesce(sum(w.w), 0) <= 0"),
                (f"w{k}", f"SELECT bucket, sum(w)::BIGINT AS w FROM (SELECT * FROM w{k - 1} UNION ALL "
                          f"SELECT x.bucket, e.f FROM wrong{k} e JOIN feats x USING (row_id)) GROUP BY bucket")]
    union = " UNION ALL ".join(f"SELECT * FROM w{k}" for k in range(1, STEPS + 1))
    return out + [("weights", f"SELECT bucket, sum(w)::BIGINT AS w FROM ({union}) GROUP BY bucket")]


@register("lr_predict", _with(_LAB, *_FRACTION, *_linear_sql())
          + "SELECT row_id, label, CASE WHEN score >= 0 THEN 'positive' ELSE 'negative' END AS pred, score FROM (SELECT f.row_id, f.label, "
            "coalesce(sum(w.w), 0)::BIGINT AS score FROM frac f LEFT JOIN feats x USING (row_id) LEFT JOIN weights w USING (bucket) "
            "WHERE f.split = 'test' GROUP BY f.row_id, f.label) s")
def q_lr_predict(spark, sf_dir):
    """Predictions and scores of the linear model (whole-number steps) for all test rows of the fractional split."""
    keys, n = counted_keys(spark, sf_dir)
    frac = fraction_split(keys, n=n)
    with_text = attach_text(spark, sf_dir, frac, bound_rows=n)
    rows = cut_lineage(hashed_words(with_text.select("row_id", "label", "split", "text")), "hashed-words")
    model = fit_linear(rows.where(F.col("split") == "train"))
    return predict_linear(model, rows.where(F.col("split") == "test"))


# ---- laid-out tables: the same jobs over text that is bucketed by its id ------------------------------------

def _laid_out(name: str, fn):
    """The query ``name`` over laid-out tables, under a name of its own; its oracle is the same."""
    def run(spark, sf_dir):
        with laid_out(spark, sf_dir):
            return fn(spark, sf_dir)
    register(name + "_laid_out", ORACLE[name])(run)


for _name in ("full_train_set", "split_fraction", "split_fraction_approx", "truncated_label_audit"):
    _laid_out(_name, QUERIES[_name])


# ---- step 6: cycles and streaming --------------------------------------------------------------------------

N_CYCLES = 3               # cycle = row_id % 3; cycle 0 trains the base model
CYCLE_SIZES = Sizes(8, 4, 0)


def cycled(spark, sf_dir):
    return labeled(spark, sf_dir, columns=("text",)).withColumn("cycle", (F.col("row_id") % N_CYCLES).cast("int"))


def cycled_keys(spark, sf_dir):
    return labeled_keys(spark, sf_dir).withColumn("cycle", (F.col("row_id") % N_CYCLES).cast("int"))


def _cycle_sql(mode: str) -> list[tuple[str, str]]:
    join = "s.src = 0 OR m.model = s.src" if mode == "star" else "m.model >= s.src"
    prev = "0" if mode == "star" else "cycle - 1"
    return [
        ("cyc", f"SELECT row_id, label, text, CAST(row_id % {N_CYCLES} AS INTEGER) AS cycle FROM labeled"),
        ("cassign", S.assign(CYCLE_SIZES.train, CYCLE_SIZES.test, src="(SELECT * FROM cyc WHERE cycle > 0)",
                             part="cycle")),
        ("srcrows", "SELECT 0 AS src, label, text FROM cyc WHERE cycle = 0 UNION ALL "
                    "SELECT cycle, label, text FROM cassign WHERE split = 'train'"),
        ("srctok", f"SELECT src, label, unnest({S.tokens()}) AS token FROM srcrows"),
        ("srccounts", "SELECT src, token, count(*) FILTER (WHERE label = 'positive') AS n_positive, "
                      "count(*) FILTER (WHERE label = 'negative') AS n_negative FROM srctok GROUP BY src, token "
                      "UNION ALL SELECT src, NULL, count(*) FILTER (WHERE label = 'positive'), "
                      "count(*) FILTER (WHERE label = 'negative') FROM srcrows GROUP BY src"),
        ("feeds", f"SELECT s.src, m.model FROM (SELECT DISTINCT src FROM srccounts) s "
                  f"JOIN (SELECT unnest(range(0, {N_CYCLES})) AS model) m ON {join}"),
        ("mcounts", "SELECT f.model, c.token, sum(c.n_positive) AS n_positive, sum(c.n_negative) AS n_negative "
                    "FROM srccounts c JOIN feeds f ON c.src = f.src GROUP BY f.model, c.token"),
        ("mparams", "SELECT model, ln(dp / (dp + dn)) AS lp_positive, ln(dn / (dp + dn)) AS lp_negative, "
                    "ln(tp + v) AS ld_positive, ln(tn + v) AS ld_negative FROM (SELECT model, "
                    "CAST(sum(n_positive) FILTER (WHERE token IS NOT NULL) AS DOUBLE) AS tp, "
                    "CAST(sum(n_negative) FILTER (WHERE token IS NOT NULL) AS DOUBLE) AS tn, "
                    "CAST(sum(n_positive) FILTER (WHERE token IS NULL) AS DOUBLE) AS dp, "
                    "CAST(sum(n_negative) FILTER (WHERE token IS NULL) AS DOUBLE) AS dn, "
                    "CAST(count(token) AS DOUBLE) AS v FROM mcounts GROUP BY model) x"),
        ("ctest", "SELECT cycle, row_id, label, text FROM cassign WHERE split = 'test'"),
        ("cruns", f"SELECT cycle, row_id, label, text, 'before' AS phase, {prev} AS model FROM ctest UNION ALL "
                  f"SELECT cycle, row_id, label, text, 'after' AS phase, cycle AS model FROM ctest"),
        ("ctok", f"SELECT model, row_id, unnest({S.tokens()}) AS token FROM cruns"),
        ("csums", "SELECT t.model, t.row_id, count(*) AS n, sum(ln(c.n_positive + 1)) AS s_positive, "
                  "sum(ln(c.n_negative + 1)) AS s_negative FROM ctok t JOIN mcounts c "
                  "ON c.model = t.model AND c.token = t.token GROUP BY t.model, t.row_id"),
        ("cscored", "SELECT r.cycle, r.phase, r.label, "
                    "p.lp_positive + coalesce(s.s_positive, 0) - coalesce(s.n, 0) * p.ld_positive AS sp, "
                    "p.lp_negative + coalesce(s.s_negative, 0) - coalesce(s.n, 0) * p.ld_negative AS sn "
                    "FROM cruns r LEFT JOIN csums s ON s.model = r.model AND s.row_id = r.row_id "
                    "JOIN mparams p ON p.model = r.model"),
        ("cpreds", f"SELECT cycle, phase, label, {_NB_PRED} AS pred FROM cscored"),
    ]


def _cycle_query(mode: str):
    def run(spark, sf_dir):
        texts = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
        preds = cycle_eval(cycled_keys(spark, sf_dir), texts, N_CYCLES, CYCLE_SIZES.train, CYCLE_SIZES.test, mode)
        return M.display(M.binary_eval(preds, "label", "pred", by=["cycle", "phase"]), DIGITS)
    return run


register("cycle_star", _with(_LAB, *_cycle_sql("star")) + S.binary_eval("cpreds", by="cycle, phase"))(
    _cycle_query("star"))
q_cycle_chain = register("cycle_chain", _with(_LAB, *_cycle_sql("chain")) + S.binary_eval("cpreds", by="cycle, phase"))(
    _cycle_query("chain"))
_laid_out("cycle_chain", q_cycle_chain)


@register("stream_cycle_counts", _with(_LAB, ("cyc", f"SELECT row_id, label, text, CAST(row_id % {N_CYCLES} AS "
                                                     f"INTEGER) AS cycle FROM labeled"),
                                       ("ctk", f"SELECT cycle, label, unnest({S.tokens()}) AS token FROM cyc"))
          + "SELECT cycle, token, count(*) FILTER (WHERE label = 'positive') AS n_positive, "
            "count(*) FILTER (WHERE label = 'negative') AS n_negative FROM ctk GROUP BY cycle, token UNION ALL "
            "SELECT cycle, NULL, count(*) FILTER (WHERE label = 'positive'), "
            "count(*) FILTER (WHERE label = 'negative') FROM cyc GROUP BY cycle")
def q_stream_cycle_counts(spark, sf_dir):
    src = cycled(spark, sf_dir).select("cycle", "row_id", "label", "text")
    folder = scratch_folder(spark, "cycles")
    write_batches(src, folder)
    out = stream_counts(spark, folder, src.schema, folder + "-counts", folder + "-ckpt")
    return out.select("cycle", "token", "n_positive", "n_negative")


@register("stream_confusion", _with(_LAB, ("t", f"SELECT row_id, label, {S.test_prompt()} AS prompt FROM labeled"),
                                    ("runs", S.fixture_runs("t")),
                                    ("enc", f"SELECT phase, {S.encode('label')} AS y_true, "
                                            f"{S.encode(S.parse())} AS y_pred FROM runs"))
          + "SELECT phase, y_true, y_pred, count(*) AS n FROM enc GROUP BY phase, y_true, y_pred")
def q_stream_confusion(spark, sf_dir):
    rows = cycled(spark, sf_dir).select("row_id", "label", "cycle", test_prompt(F.col("text")).alias("prompt"))
    runs = fixture_raw(rows).select("cycle", "phase", "label", "raw")
    folder = scratch_folder(spark, "scored")
    write_batches(runs, folder)
    out = stream_confusion(spark, folder, runs.schema, folder + "-confusion", folder + "-ckpt")
    return out.select("phase", "y_true", "y_pred", "n")


_PREQUENTIAL = [
    ("pcyc", f"SELECT row_id, label, text, split, CAST(row_id % {N_CYCLES} AS INTEGER) AS cycle FROM approx WHERE label IN ('positive', 'negative')"),
    ("srcrows", "SELECT cycle AS src, label, text FROM pcyc WHERE split = 'train'"),
    *[c for c in _cycle_sql("chain") if c[0] in ("srctok", "srccounts", "feeds", "mcounts", "mparams")],
    ("cruns", "SELECT cycle, row_id, label, text, 'before' AS phase, cycle - 1 AS model FROM pcyc WHERE split <> 'train' AND cycle > 0 UNION ALL "
              "SELECT cycle, row_id, label, text, 'after', cycle FROM pcyc WHERE split <> 'train'"),
    *[c for c in _cycle_sql("chain") if c[0] in ("ctok", "csums", "cscored", "cpreds")],
]


@register("stream_test_then_train", _with(_LAB, _APPROX, *_PREQUENTIAL)
          + "SELECT cycle AS version, * EXCLUDE (cycle) FROM (" + S.binary_eval("cpreds", by="cycle, phase") + ")")
def q_stream_test_then_train(spark, sf_dir):
    """Cycle after cycle arrives: each is scored with the model before it, added, and scored again; metrics of every version."""
    src = cycled(spark, sf_dir).select("cycle", "row_id", "label", "text")
    folder = scratch_folder(spark, "arrivals")
    for k in range(N_CYCLES):
        src.where(F.col("cycle") == k).write.parquet(f"{folder}/batch-{k}")
        conf = test_then_train(spark, folder, src.schema, folder + "-counts", folder + "-ckpt")
    return M.display(M.summary(conf, ["version", "phase"], per_class=(0, 1)), DIGITS)


@register("model_versions", _with(_LAB, *_cycle_sql("chain"))
          + "SELECT model AS cycle, 2 AS version, count(token) AS n_tokens, sum(n_positive)::BIGINT AS n_positive, sum(n_negative)::BIGINT AS n_negative "
            "FROM mcounts WHERE token IS NOT NULL GROUP BY model")
def q_model_versions(spark, sf_dir):
    """A chain of cycle models, saved as two versions of a run beside another run's; the published version read back."""
    keys = cycled_keys(spark, sf_dir)
    assign = stratified_split(keys.where(F.col("cycle") > 0).select("cycle", "row_id", "label"), CYCLE_SIZES.train, CYCLE_SIZES.test, group_cols=["cycle"])
    used = (keys.join(F.broadcast(assign.select("cycle", "row_id", "split")), ["cycle", "row_id"], "left")    # cycles x classes x sizes rows
            .where((F.col("cycle") == 0) | (F.col("split") == "train")))
    texts = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    models = cut_lineage(cycle_models(used.join(texts, "row_id").select(F.col("cycle").alias("src"), "label", "text"), N_CYCLES, "chain"), "chain")
    models = models.withColumnRenamed("model", "cycle")
    folder = scratch_folder(spark, "versions")
    for run, version in (("quality-chain", 1), ("other-run", 7), ("quality-chain", 2), ("quality-chain", 2)):    # the last one is a repeated job
        part = models if version != 1 else models.where("cycle < 2")
        save_version(part, folder, run, version)
        publish_version(spark, folder, run, version)
    words = load_version(spark, folder, "quality-chain").where(F.col("token").isNotNull())
    return (words.groupBy("cycle").agg(F.lit(published_version(spark, folder, "quality-chain")).alias("version"), F.count("token").alias("n_tokens"),
                                       F.sum("n_positive").alias("n_positive"), F.sum("n_negative").alias("n_negative")))


# ---- step 7: sources and sinks -----------------------------------------------------------------------------

def _na_sql(c: str) -> str:
    from ..functions.text import NA_STRINGS
    lits = ", ".join("'" + s.replace("'", "''") + "'" for s in NA_STRINGS)
    return f"CASE WHEN {c} IN ({lits}) THEN NULL ELSE {c} END"


@register("csv_roundtrip", _with(_LAB) + f"SELECT 'quality' AS dataset, {_na_sql('label')} AS label, "
                                         f"{_na_sql('text')} AS text FROM labeled")
def q_csv_roundtrip(spark, sf_dir):
    folder = scratch_folder(spark, "csv") + "/data/quality/data.csv"
    write_labelled_csv(labeled(spark, sf_dir, columns=("text",)), folder)
    return read_labelled_csv(spark, folder).select("dataset", "label", "text")


_CSV_ROWS = ("csvrows", " UNION ALL ".join(
    f"SELECT '{d}' AS dataset, CAST(row_id % {N_CYCLES} AS INTEGER) AS cycle, {_na_sql('label')} AS label, {_na_sql('text')} AS text "
    f"FROM ({S.labeled(d)})" for d in ("quality", "toxic")))


def csv_files(spark, sf_dir):
    """Both tasks' labelled texts as numbered headerless CSV files, ``data/<dataset>/data-<cycle>.csv``."""
    root = scratch_folder(spark, "csv")
    texts = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    rows = cut_lineage(multi_task(spark, sf_dir).join(texts, "row_id"), "csv-rows")
    paths = [(d, k, f"{root}/data/{d}/data-{k}.csv") for d in ("quality", "toxic") for k in range(N_CYCLES)]
    for d, k, path in paths:
        write_labelled_csv(rows.where((F.col("dataset") == d) & (F.col("row_id") % N_CYCLES == k)), path)
    return [path for _, _, path in paths]


@register("csv_multi_file", _with(_CSV_ROWS) + "SELECT dataset, cycle, label, text, false AS ragged, "
                                              "false AS bad_bytes FROM csvrows")
def q_csv_multi_file(spark, sf_dir):
    rows = read_labelled_csv(spark, csv_files(spark, sf_dir), on_bad_bytes="quarantine", on_ragged="flag", with_row_id=False)
    return rows.select("dataset", "cycle", "label", "text", "ragged", "bad_bytes")


@register("csv_row_ids", _with(_CSV_ROWS) + "SELECT dataset, cycle, count(*) AS n_rows, count(*) AS n_ids FROM csvrows GROUP BY dataset, cycle")
def q_csv_row_ids(spark, sf_dir):
    """Strict reading (bad bytes and ragged rows fail): every row of every numbered file has an id of its own."""
    rows = read_labelled_csv(spark, csv_files(spark, sf_dir), on_bad_bytes="error")
    return rows.groupBy("dataset", "cycle").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("row_id").alias("n_ids"))


_RAW_ROWS = ("rawrows", f"SELECT row_id, row_id % 3 AS kind, CAST(row_id % {N_CYCLES} AS INTEGER) AS cycle, label, text FROM labeled")


def csv_raw_bytes(spark, sf_dir):
    """All labelled texts in a file of every cycle: of three rows one ends in a broken byte sequence, one in a valid U+FFFD."""
    folder = f"{scratch_folder(spark, 'csv')}/data/quality"
    end = F.when(F.col("row_id") % 3 == 0, F.lit(b"\xe2\x82")).when(F.col("row_id") % 3 == 1, F.lit("\ufffd".encode())).otherwise(F.lit(b""))
    quoted = F.concat(F.lit('"'), F.regexp_replace("text", '"', '""'))
    line = F.concat(F.concat(F.coalesce("label", F.lit("")), F.lit(","), quoted).cast("binary"), end, F.lit(b'"'))
    rows = labeled(spark, sf_dir, columns=("text",)).select(line.cast("string").alias("value"), (F.col("row_id") % N_CYCLES).alias("_cycle"))
    rows.write.partitionBy("_cycle").text(folder)
    return folder


@register("csv_bad_bytes", _with(_LAB, _RAW_ROWS) + "SELECT 'quality' AS dataset, label, CASE kind WHEN 2 THEN text ELSE text || chr(65533) END AS text, "
                                                    "kind = 0 AS bad_bytes FROM rawrows")
def q_csv_bad_bytes(spark, sf_dir):
    """The strict reader's quarantine: broken bytes are flagged (and shown as U+FFFD), a U+FFFD of the file is not."""
    return (read_labelled_csv(spark, csv_raw_bytes(spark, sf_dir), on_bad_bytes="quarantine", with_row_id=False)
            .select("dataset", "label", "text", "bad_bytes"))


ROWS_PER_FILE = 200       # ids of a file in ``csv_line_numbers``


@register("csv_line_numbers", _with(_LAB) + f"SELECT row_id // {ROWS_PER_FILE} AS file_no, row_number() OVER (PARTITION BY row_id // {ROWS_PER_FILE} "
                                            f"ORDER BY row_id) - 1 AS line_no, {_na_sql('label')} AS label, md5({_na_sql('text')}) AS text_md5 FROM labeled")
def q_csv_line_numbers(spark, sf_dir):
    """Files of sorted rows, read back: the number of every row in its file is its place there (texts span lines)."""
    folder = f"{scratch_folder(spark, 'csv')}/data/quality"
    rows = labeled(spark, sf_dir, columns=("text",)).withColumn("file_no", F.expr(f"row_id div {ROWS_PER_FILE}"))
    (rows.repartition("file_no").sortWithinPartitions("file_no", "row_id").select("file_no", "label", "text").write.partitionBy("file_no")
     .option("header", False).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(folder))
    got = read_labelled_csv(spark, folder, on_bad_bytes="error")
    return got.select(F.regexp_extract("file_path", r"file_no=(\d+)", 1).cast("long").alias("file_no"),
                      F.col("row_id").bitwiseAND((1 << 33) - 1).alias("line_no"), "label", F.md5("text").alias("text_md5"))


@register("metrics_log", ORACLE["metrics_long"])
def q_metrics_log(spark, sf_dir):
    folder = scratch_folder(spark, "metrics")
    longf = metrics_record(spark, sf_dir)
    for phase in ("before", "after"):   # two appends, as the before and after steps each log once
        append_metrics(longf.where(F.col("phase") == phase), folder)
    return M.display(read_metrics(spark, folder), DIGITS)


@register("metrics_log_repeated", ORACLE["metrics_long"])
def q_metrics_log_repeated(spark, sf_dir):
    """A job that logs each phase, fails, and is repeated: one record of each metric is read, the last attempt's."""
    folder = scratch_folder(spark, "metrics")
    longf = cut_lineage(metrics_record(spark, sf_dir), "metrics-record")
    stale = longf.withColumn("value", F.lit(-1.0))
    for rows, phase, attempt in ((stale, "before", 1), (longf, "before", 1), (stale, "after", 1), (longf, "after", 2), (longf, "after", 2)):
        log_metrics(rows.where(F.col("phase") == phase), folder, attempt)
    return M.display(read_log(spark, folder), DIGITS)


@register("splits_sink", _with(*_BUNDLE) + "SELECT split, row_id, label, ord, prompt FROM bundle")
def q_splits_sink(spark, sf_dir):
    folder = scratch_folder(spark, "splits")
    return write_splits(bundle(spark, sf_dir, SIZES), folder).select("split", "row_id", "label", "ord", "prompt")


@register("model_roundtrip", _with(_LAB, _ASSIGN, *_NB_FIT,
                                   ("testrows", "SELECT row_id, label, text FROM assign WHERE split = 'test'"),
                                   *_nb_sql("testrows", "row_id"))
          + f"SELECT row_id, {_NB_PRED} AS pred, round(sp, 4) AS score_positive, round(sn, 4) AS score_negative "
            f"FROM scored")
def q_model_roundtrip(spark, sf_dir):
    folder = scratch_folder(spark, "model")
    save_counts(NB.token_counts(split_texts(spark, sf_dir, "train")), folder)
    model = NB.fit(load_counts(spark, folder), materialize=False)
    return M.display(NB.predict(model, split_texts(spark, sf_dir, "test")), 4)
