"""Physical-plan checks: no Python in the native operators, pruned scans, no text shuffle where the key
set is bounded."""

from oracle_harness import SF
from labelwise.plans import catalog

PYTHON = {"score_map_in_pandas", "subword_pad_truncate", "truncated_label_audit_subwords"}   # the queries with a Python step


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_native_operators(spark):
    for name in sorted(set(catalog.QUERIES) - PYTHON):
        plan = _plan(catalog.QUERIES[name](spark, SF["0.01"]))
        assert not any(x in plan for x in ("Python", "ArrowEval", "MapInPandas", "MapInArrow")), name


def test_scoring_uses_arrow_batches(spark):
    plan = _plan(catalog.QUERIES["score_map_in_pandas"](spark, SF["0.01"]))
    assert "MapInPandas" in plan or "PythonMapInArrow" in plan or "MapInArrow" in plan


def test_prompt_text_joined_by_broadcast_and_pruned(spark):
    df = catalog.QUERIES["prompt_test"](spark, SF["0.01"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    # the documents scan reads only the id and the text
    scans = [line for line in plan.splitlines() if "documents.parquet" in line or "ReadSchema" in line]
    assert any("struct<doc_id:bigint,text:string>" in s for s in scans)


def test_split_window_limited_before_shuffle(spark):
    """The per-class top-k keeps at most k rows per class per partition before the exchange."""
    plan = _plan(catalog.QUERIES["split_stratified"](spark, SF["0.01"]))
    assert "WindowGroupLimit" in plan


def test_texts_are_dealt_only_where_the_caller_asks(spark):
    from labelwise.session import SPREAD_SETTING, spread
    docs = spark.read.parquet(f"{SF['0.01']}/documents.parquet").select("doc_id", "text")
    old = spark.conf.get(SPREAD_SETTING)
    try:
        spark.conf.unset(SPREAD_SETTING)
        assert spread(docs) is docs
        spark.conf.set(SPREAD_SETTING, "5")
        assert spread(docs).rdd.getNumPartitions() == 5
    finally:
        spark.conf.set(SPREAD_SETTING, old)


def test_no_pairs_joins_in_any_query(spark):
    """No registered query plans a cartesian product or a nested-loop join (no all-pairs step)."""
    for name, fn in catalog.QUERIES.items():
        plan = _plan(fn(spark, SF["0.01"]))   # registered split sizes need sf0.01 or larger
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def _ancestors(plan: str, pred) -> list[list[str]]:
    """For each plan line matching ``pred``, the node lines above it in the tree (nearest parent first)."""
    lines = plan.splitlines()

    def depth(s: str) -> int:
        return len(s) - len(s.lstrip(" :|+-"))

    out = []
    for i, line in enumerate(lines):
        if pred(line):
            chain, d = [], depth(line)
            for up in reversed(lines[:i]):
                if depth(up) < d:
                    chain.append(up.strip(" :|+-"))
                    d = depth(up)
            out.append(chain)
    return out


def test_prompt_sets_stream_text_without_shuffle(spark):
    """Bounded or counted key sets are broadcast: no exchange sits above the documents text scan."""
    for name in ("prompt_test", "prompt_train", "eval_bootstrap", "full_train_set", "split_fraction"):
        plan = _plan(catalog.QUERIES[name](spark, SF["0.01"]))
        chains = _ancestors(plan, lambda s: "FileScan" in s and "documents.parquet" in s and "text:string" in s)
        assert chains, name
        for chain in chains:
            assert not any(node.startswith("Exchange") for node in chain), (name, chain)


def test_counted_labels_stream_text_without_shuffle(spark):
    """Labels within the counted limit are broadcast, whatever the planner's own threshold says."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("truncated_label_audit", "truncated_label_audit_subwords", "split_fraction_approx"):
            plan = _plan(catalog.QUERIES[name](spark, SF["0.01"]))
            chains = _ancestors(plan, lambda s: "FileScan" in s and "documents.parquet" in s and "text:string" in s)
            assert chains, name
            for chain in chains:
                below = [node for node in chain[:next(i for i, n in enumerate(chain) if "Join" in n) + 1]]
                assert not any(node.startswith("Exchange") for node in below), (name, chain)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_cut_lineage_computes_input_once(spark):
    """The materialised table is computed exactly once and read back whole."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import LongType

    from labelwise.session import cut_lineage
    seen = spark.sparkContext.accumulator(0)

    def touch(x):   # test-only probe counting row evaluations
        seen.add(1)
        return x

    probe = F.udf(touch, LongType())
    out = cut_lineage(spark.range(100).select(probe("id").alias("id")), "probe")
    assert out.count() == 100 and sorted(r["id"] for r in out.collect()) == list(range(100))
    assert seen.value == 100


def _text_scans(plan: str) -> int:
    return sum("FileScan" in line and "documents.parquet" in line and "text:string" in line for line in plan.splitlines())


def test_texts_are_read_once(spark):
    """All three split sets, and a before/after evaluation, read the document text in one scan."""
    from labelwise.plans.dataset import bundle
    assert _text_scans(_plan(bundle(spark, SF["0.01"], catalog.SIZES))) == 1
    assert _text_scans(_plan(catalog.QUERIES["split_sizes"](spark, SF["0.01"]))) == 0
    assert _text_scans(_plan(catalog.QUERIES["nb_before_after"](spark, SF["0.01"]))) == 1
    assert _text_scans(_plan(catalog.QUERIES["tokens_pad_truncate"](spark, SF["0.01"]))) == 1   # the vocabulary is stored


def test_bootstrap_does_not_shuffle_the_pool(spark):
    """With automatic broadcasts off, the rows of buckets that no draw hits are dropped before any exchange: every shuffle
    join is on the few located draws."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(catalog.QUERIES["eval_bootstrap"](spark, SF["0.01"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert semi and all("BroadcastHashJoin" in line for line in semi)


def test_scratch_tables_have_an_owner(spark):
    from labelwise.session import cut_lineage, path_exists, scratch_scope
    with scratch_scope(spark):
        df = cut_lineage(spark.range(5), "owned")
        path = df.inputFiles()[0].rsplit("/", 1)[0]
        assert df.count() == 5 and path_exists(spark, path)
    assert not path_exists(spark, path)


def test_tables_are_listed_anew(spark, tmp_path):
    """Rows appended between two reads are seen by the second."""
    from labelwise.sources.tables import read_table
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    assert read_table(spark, str(tmp_path), "t").count() == 3
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    assert read_table(spark, str(tmp_path), "t").count() == 8


def test_rows_without_words_never_share_a_join_key(spark):
    from pyspark.sql import functions as F

    from labelwise.operators.tokens import decode, explode_tokens, token_ids, vocabulary, word_key
    docs = spark.createDataFrame([(i, None if i % 2 else " .. ") for i in range(50)] + [(99, "b a b")], "row_id long, text string")
    toks = explode_tokens(docs, outer=True)
    keys = toks.select(word_key(F.col("token"), F.col("row_id")).alias("k"))
    assert keys.where("k is null").count() == 0 and keys.distinct().count() == 52
    vocab = vocabulary(toks)
    assert sorted(map(tuple, vocab.collect())) == [("a", 1), ("b", 2)] and dict(vocab.dtypes)["id"] == "bigint"
    ids = token_ids(toks, vocab)
    assert {r.row_id: r.ids for r in ids.collect()} == {**{i: [] for i in range(50)}, 99: [2, 1, 2]}
    padded = ids.select("row_id", F.concat("ids", F.array(F.lit(0).cast("long"), F.lit(-100).cast("long"))).alias("ids"))
    assert {r.row_id: r.decoded for r in decode(padded, "ids", vocab).collect()} == {**{i: "" for i in range(50)}, 99: "b a b"}


def _text_exchanges(df):
    """Exchanges (broadcasts apart) and those of them that move texts or prompts."""
    import re

    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    moved = re.findall(r"\(\d+\) Exchange\n?.*?\nInput \[\d+\]: (.*)", df._jdf.queryExecution().explainString(mode))
    return moved, [m for m in moved if "text#" in m or "prompt#" in m]


def test_laid_out_text_is_never_exchanged(spark, monkeypatch):
    """Without any broadcast, as beyond the limits: plain tables move the text once, laid-out tables never."""
    from labelwise import session
    from labelwise.sources import layout, tables

    monkeypatch.setattr(session, "BROADCAST_ROW_LIMIT", -1)
    monkeypatch.setattr(tables, "BROADCAST_ROW_LIMIT", -1)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", session.SPREAD_SETTING)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.unset(session.SPREAD_SETTING)
    try:
        layout.lay_out(spark, SF["0.001"])
        for name in ("full_train_set", "split_fraction", "split_fraction_approx", "truncated_label_audit", "lr_predict"):
            assert not _text_exchanges(catalog.QUERIES[name](spark, SF["0.001"]))[1], name
        assert _text_exchanges(catalog.QUERIES["split_fraction_approx"](spark, SF["0.001"])) == ([], [])
        layout.forget(spark, SF["0.001"])
        assert _text_exchanges(catalog.QUERIES["full_train_set"](spark, SF["0.001"]))[1]
    finally:
        layout.forget(spark, SF["0.001"])
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_approximate_split_adds_no_exchange(spark):
    from labelwise.operators.splits import fraction_split_approx
    from labelwise.sources.tables import read_table

    docs = read_table(spark, SF["0.01"], "documents").select("doc_id", "text")
    assert "Exchange" not in _plan(fraction_split_approx(docs, id_col="doc_id"))
