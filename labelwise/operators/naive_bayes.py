"""Multinomial naive Bayes as DataFrame counts (the distributed baseline classifier).

Fit is two aggregations: token counts per class (``groupBy(token)`` with one conditional count per class,
map-side combined, one shuffle), written once to the shared checkpoint folder, and a handful of scalars
(class sizes, token totals, vocabulary size and bytes) collected as one row. With Laplace smoothing
``alpha``::

    log P(t | c) = ln(n_tc + alpha) - ln(total_c + alpha * V)
    score(d, c)  = ln(prior_c) + sum_{t in d, t in V} [ln(n_tc + alpha) - ln(total_c + alpha * V)]

``ln(0 + 1) = 0``, so with alpha = 1 only tokens seen in training contribute to the first sum. Predicting
is one left join of the document tokens to the count table (shuffle on token, or broadcast when the
counted vocabulary rows and bytes are small) and one ``groupBy`` per document. Ties go to the first class.
Models can be updated by adding count tables (``merge_counts``), which is how new data batches extend a
base model.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.answers import CLASSES
from ..session import BROADCAST_BYTE_LIMIT, BROADCAST_ROW_LIMIT, cut_lineage, maybe_broadcast, spread
from ..functions.text import word_tokens
from .tokens import word_key


def _cnt(c: str) -> str:
    return f"n_{c}"


def token_counts(docs: DataFrame, classes: Sequence[str] = CLASSES, text_col: str = "text",
                 id_col: str = "row_id", label_col: str = "label") -> DataFrame:
    """``(token, n_<class>...)`` over the whole texts of ``docs``; also carries per-class doc counts in
    the reserved row ``token IS NULL`` so a count table is self-contained and additive."""
    labelled = docs.where(F.col(label_col).isin(*classes))
    toks = (spread(labelled.select(text_col, label_col))
            .select(F.explode(word_tokens(F.col(text_col))).alias("token"), F.col(label_col).alias("_lab")))
    # one conditional count per class: a single map-side-combined aggregate (one shuffle on token)
    words = toks.groupBy("token").agg(*_class_counts("_lab", classes))
    docs_row = labelled.agg(*_class_counts(label_col, classes)).withColumn("token", F.lit(None).cast("string"))
    cols = ["token"] + [_cnt(c) for c in classes]
    return words.select(*cols).unionByName(docs_row.select(*cols))


def _class_counts(label_col: str, classes: Sequence[str]) -> list:
    return [F.count(F.when(F.col(label_col) == F.lit(c), True)).cast("long").alias(_cnt(c)) for c in classes]


def merge_counts(*tables: DataFrame, classes: Sequence[str] = CLASSES, key: str | None = None) -> DataFrame:
    """Sum count tables (base model + new batches), per ``key`` when given."""
    u = tables[0]
    for t in tables[1:]:
        u = u.unionByName(t)
    keys = [key, "token"] if key else ["token"]
    return u.groupBy(*keys).agg(*[F.sum(_cnt(c)).cast("long").alias(_cnt(c)) for c in classes])


@dataclass
class NBModel:
    counts: DataFrame           # (token, n_<class>...) incl. the NULL-token doc-count row
    classes: tuple
    log_prior: dict
    log_denom: dict
    vocab_size: int
    alpha: float = 1.0
    vocab_bytes: int = 0        # UTF-8 bytes of all training tokens (counted in ``fit``)

    def table_bytes(self) -> int:
        """Size of the word table in a Python worker: token bytes, the cost of an object and an index entry per token
        and a double per class."""
        return self.vocab_bytes + self.vocab_size * (120 + 8 * len(self.classes))

    def broadcastable(self) -> bool:
        """Whether the counted word table is within both broadcast limits (rows and bytes)."""
        return self.vocab_size <= BROADCAST_ROW_LIMIT and self.table_bytes() <= BROADCAST_BYTE_LIMIT

    def word_table(self) -> DataFrame:
        """``(token, lc_<class>...)`` with ``lc = ln(n + alpha)``; only training tokens."""
        return self.counts.where(F.col("token").isNotNull()).select(
            "token", *[F.log(F.col(_cnt(c)) + F.lit(self.alpha)).alias(f"lc_{c}") for c in self.classes])


def fit(counts: DataFrame, classes: Sequence[str] = CLASSES, alpha: float = 1.0,
        materialize: bool = True) -> NBModel:
    """Scalars of the model from a count table (one small aggregate row reaches the driver).

    ``materialize``: the count table is written once to the shared checkpoint folder (reliable
    checkpoint), so the scalars here and every later prediction read it instead of tokenising the
    training texts again. Pass ``False`` for a table that is already stored (a loaded model)."""
    if materialize:
        counts = cut_lineage(counts, "nb-counts")
    words = F.col("token").isNotNull()
    aggs = [F.sum(F.when(words, F.col(_cnt(c)))).alias(f"tot_{c}") for c in classes]
    aggs += [F.sum(F.when(~words, F.col(_cnt(c)))).alias(f"docs_{c}") for c in classes]
    aggs.append(F.count(F.when(words, True)).alias("V"))
    aggs.append(F.sum(F.when(words, F.octet_length("token"))).alias("B"))
    row = counts.agg(*aggs).collect()[0]
    n_docs = sum(row[f"docs_{c}"] or 0 for c in classes)
    v = row["V"] or 0
    log_prior = {c: (math.log(row[f"docs_{c}"] / n_docs) if row[f"docs_{c}"] else float("-inf")) for c in classes}
    log_denom = {c: math.log((row[f"tot_{c}"] or 0) + alpha * v) if v else 0.0 for c in classes}
    return NBModel(counts, tuple(classes), log_prior, log_denom, v, alpha, row["B"] or 0)


def predict(model: NBModel, docs: DataFrame, text_col: str = "text", id_col: str = "row_id",
            carry: Sequence[str] = ()) -> DataFrame:
    """``(id, *carry, pred, score_<class>...)`` for every row of ``docs`` (rows without known tokens get the
    prior). The word table's size was counted by ``fit``: within the broadcast limits (rows and bytes) it
    is broadcast, otherwise the join shuffles on token (AQE splits hot tokens)."""
    table = model.word_table()
    if model.broadcastable():
        table = F.broadcast(table)
    # outer explode + left join: a document without known words keeps one row with NULL scores, so one
    # aggregate per document yields every document (no second join back to the document ids)
    toks = (spread(docs.select(id_col, *carry, text_col), id_col)
            .select(id_col, *carry, F.explode_outer(word_tokens(F.col(text_col))).alias("token"))
            .withColumn("token", word_key(F.col("token"), F.col(id_col))))
    first = f"lc_{model.classes[0]}"
    joined = (toks.join(table, "token", "left").groupBy(id_col, *carry)
              .agg(F.count(first).alias("_n"), *[F.sum(f"lc_{c}").alias(f"_s_{c}") for c in model.classes]))
    scores = {c: (F.lit(model.log_prior[c]) + F.coalesce(F.col(f"_s_{c}"), F.lit(0.0))
                  - F.coalesce(F.col("_n"), F.lit(0)) * F.lit(model.log_denom[c])) for c in model.classes}
    best = F.greatest(*scores.values()) if len(scores) > 1 else list(scores.values())[0]
    pred = None
    for c in model.classes:
        pred = (F.when(scores[c] == best, F.lit(c)) if pred is None else pred.when(scores[c] == best, F.lit(c)))
    return joined.select(id_col, *carry, pred.alias("pred"), *[s.alias(f"score_{c}") for c, s in scores.items()])


def prior_class(model: NBModel) -> str:
    """Text-blind baseline: the class with the largest prior (first class on ties)."""
    return max(model.classes, key=lambda c: (model.log_prior[c], -model.classes.index(c)))


def prior_predict(model: NBModel, docs: DataFrame, id_col: str = "row_id") -> DataFrame:
    return docs.select(id_col, F.lit(prior_class(model)).alias("pred"))


def predictor_table(model: NBModel, max_rows: int = BROADCAST_ROW_LIMIT):
    """``(tokens, log counts)`` of the word table as arrays for per-task predictors; refuses vocabularies over
    ``max_rows`` tokens or over the broadcast byte limit (both counted by ``fit`` before anything is collected)."""
    n = model.vocab_size
    if n > max_rows or model.table_bytes() > BROADCAST_BYTE_LIMIT:
        raise ValueError(f"vocabulary of {n} tokens ({model.table_bytes()} bytes) exceeds the predictor "
                         f"limits ({max_rows} tokens, {BROADCAST_BYTE_LIMIT} bytes); use predict()")
    rows = model.word_table().toPandas()
    return rows["token"].to_numpy(object), rows[[f"lc_{c}" for c in model.classes]].to_numpy(float)


# ---- many models at once (one per key, e.g. per cycle) ----------------------------------------------------

def keyed_token_counts(docs: DataFrame, key: str, classes: Sequence[str] = CLASSES, text_col: str = "text",
                       label_col: str = "label") -> DataFrame:
    """``(key, token, n_<class>...)`` per key value, including each key's NULL-token doc-count row."""
    lab = F.col(label_col)
    labelled = docs.where(lab.isin(*classes))
    toks = (spread(labelled.select(key, text_col, label_col))
            .select(key, F.explode(word_tokens(F.col(text_col))).alias("token"), lab.alias("_lab")))
    words = toks.groupBy(key, "token").agg(*_class_counts("_lab", classes))
    docs_rows = labelled.groupBy(key).agg(*_class_counts(label_col, classes)).withColumn(
        "token", F.lit(None).cast("string"))
    cols = [key, "token"] + [_cnt(c) for c in classes]
    return words.select(*cols).unionByName(docs_rows.select(*cols))


def keyed_params(counts: DataFrame, key: str, classes: Sequence[str] = CLASSES, alpha: float = 1.0) -> DataFrame:
    """``(key, lp_<class>, ld_<class>...)``: log prior and log denominator of every keyed model, as ``fit`` has
    them (a class without documents: minus infinity)."""
    words = F.col("token").isNotNull()
    aggs = [F.sum(F.when(words, F.col(_cnt(c)))).alias(f"tot_{c}") for c in classes]
    aggs += [F.sum(F.when(~words, F.col(_cnt(c)))).cast("double").alias(f"docs_{c}") for c in classes]
    aggs.append(F.count(F.when(words, True)).alias("V"))
    n_docs = sum((F.col(f"docs_{c}") for c in classes), F.lit(0.0))
    return counts.groupBy(key).agg(*aggs).select(
        key, *[F.when(F.col(f"docs_{c}") > 0, F.log(F.col(f"docs_{c}") / n_docs)).otherwise(F.lit(float("-inf")))
               .alias(f"lp_{c}") for c in classes],
        *[F.when(F.col("V") > 0, F.log(F.coalesce(F.col(f"tot_{c}"), F.lit(0)) + F.lit(alpha) * F.col("V")))
          .otherwise(F.lit(0.0)).alias(f"ld_{c}") for c in classes])


def keyed_predict(counts: DataFrame, params: DataFrame, docs: DataFrame, key: str, id_col: str = "row_id",
                  text_col: str = "text", classes: Sequence[str] = CLASSES, alpha: float = 1.0,
                  params_rows: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Score each row of ``docs`` with the model named by its ``key`` column; ``(key, id)`` is unique.

    ``params`` has one row per model; ``params_rows`` (the number of models) bounds it for a broadcast.
    ``carry``: columns of ``docs`` passed through to the output (constant per row, so they ride along in
    the per-row aggregate instead of needing a join back)."""
    table = counts.where(F.col("token").isNotNull()).select(
        key, "token", *[F.log(F.col(_cnt(c)) + F.lit(alpha)).alias(f"lc_{c}") for c in classes])
    toks = (spread(docs.select(key, id_col, *carry, text_col), id_col)
            .select(key, id_col, *carry, F.explode_outer(word_tokens(F.col(text_col))).alias("token"))
            .withColumn("token", word_key(F.col("token"), F.col(id_col))))
    sums = (toks.join(table, [key, "token"], "left").groupBy(key, id_col, *carry)
            .agg(F.count(f"lc_{classes[0]}").alias("_n"), *[F.sum(f"lc_{c}").alias(f"_s_{c}") for c in classes]))
    joined = sums.join(maybe_broadcast(params, params_rows), key)
    scores = {c: (F.col(f"lp_{c}") + F.coalesce(F.col(f"_s_{c}"), F.lit(0.0))
                  - F.coalesce(F.col("_n"), F.lit(0)) * F.col(f"ld_{c}")) for c in classes}
    best = F.greatest(*scores.values())
    pred = None
    for c in classes:
        pred = F.when(scores[c] == best, F.lit(c)) if pred is None else pred.when(scores[c] == best, F.lit(c))
    return joined.select(key, id_col, *carry, pred.alias("pred"), *[s.alias(f"score_{c}") for c, s in scores.items()])
