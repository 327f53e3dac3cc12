"""Independent SQL (DuckDB dialect) for the correctness oracle.

Each registered query has a plain one-level SQL formulation here: global windows instead of the two-level
index, ``row_number`` over whole classes instead of the candidate pre-filter. The Spark and SQL sides
share only the fixed values (prompt text, seeds, patterns), never the plan.
"""

from __future__ import annotations

from ..functions.prompts import TEST_HEAD, TEST_TAIL, TRAIN_HEAD, TRAIN_SEP, sql_literal
from ..functions.text import RSTRIP_PATTERN, TOKEN_SPLIT_PATTERN


def labeled(task: str = "quality") -> str:
    flag = "l.quality" if task == "quality" else "(1 - l.toxic)"
    return (f"SELECT d.doc_id AS row_id, CASE WHEN {flag} = 1 THEN 'positive' WHEN {flag} IS NOT NULL THEN 'negative' END AS label, "
            f"d.text AS text FROM documents d JOIN labels l ON d.doc_id = l.doc_id")


def key(seed, col: str) -> str:
    return f"md5('{seed}:' || CAST({col} AS VARCHAR))"


def hex15(expr: str) -> str:
    return f"('0x' || substr({expr}, 1, 15))::BIGINT"


def assign(train: int, test: int, src: str = "labeled", seed: int = 42, part: str = "") -> str:
    p = f"{part}, " if part else ""
    return (f"SELECT {p}row_id, label, text, CASE WHEN rank <= {train} THEN 'train' ELSE 'test' END AS split, rank "
            f"FROM (SELECT {p}row_id, label, text, row_number() OVER (PARTITION BY {p}label "
            f"ORDER BY {key(seed, 'row_id')}, row_id) AS rank FROM {src} "
            f"WHERE label IN ('positive', 'negative')) r WHERE rank <= {train + test}")


def test_prompt(text: str = "text") -> str:
    return f"({sql_literal(TEST_HEAD)} || coalesce({text}, 'nan') || {sql_literal(TEST_TAIL)})"


def train_prompt(text: str = "text", label: str = "label") -> str:
    body = f"{sql_literal(TRAIN_HEAD)} || coalesce({text}, 'nan') || {sql_literal(TRAIN_SEP)} || coalesce({label}, 'nan')"
    return f"regexp_replace({body}, {sql_literal(RSTRIP_PATTERN)}, '')"


def fixture_runs(src: str, prompt: str = "prompt") -> str:
    """Two raw outputs per row of ``src`` (columns row_id, label, prompt)."""
    opp = "CASE WHEN label = 'positive' THEN 'negative' ELSE 'positive' END"
    before = f"CASE WHEN row_id % 7 = 0 THEN 'maybe' WHEN row_id % 3 = 0 THEN {opp} ELSE label END"
    after = f"CASE WHEN row_id % 11 = 0 THEN {opp} ELSE label END"

    def cased(a: str) -> str:
        return f"CASE WHEN row_id % 2 = 0 THEN upper(substr({a}, 1, 1)) || substr({a}, 2) ELSE {a} END"

    return (f"SELECT *, {prompt} || ' ' || answer AS raw FROM ("
            f"SELECT *, 'before' AS phase, {cased(before)} AS answer FROM {src} UNION ALL "
            f"SELECT *, 'after' AS phase, {cased(after)} AS answer FROM {src})")


def parse(raw: str = "raw", case_sensitive: bool = False) -> str:
    tail = f"regexp_extract({raw}, '([^=]*)\\z', 1)"
    if not case_sensitive:
        tail = f"lower({tail})"
    return (f"CASE WHEN contains({tail}, 'positive') THEN 'positive' "
            f"WHEN contains({tail}, 'negative') THEN 'negative' ELSE 'none' END")


def encode(c: str) -> str:
    return f"CASE WHEN {c} = 'negative' THEN 0 ELSE 1 END"


def class_stats(conf: str, by: str = "") -> str:
    """``conf`` has columns (by..., y_true, y_pred, n)."""
    b = f"{by}, " if by else ""
    return (f"SELECT {b}cls, sum(tp) AS tp, sum(pp) AS pp, sum(support) AS support FROM ("
            f"SELECT {b}CAST(y_true AS VARCHAR) AS cls, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp, "
            f"0 AS pp, n AS support FROM {conf} UNION ALL "
            f"SELECT {b}CAST(y_pred AS VARCHAR) AS cls, 0 AS tp, n AS pp, 0 AS support FROM {conf}) s "
            f"GROUP BY {b}cls")


def ratio(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) = 0 THEN 0.0::DOUBLE ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END"


def summary(stats: str, by: str = "", per_class=(0, 1), digits: int | None = 6) -> str:
    b = f"{by}, " if by else ""
    f1 = ratio("2 * tp", "pp + support")
    shown = (lambda x: x) if digits is None else (lambda x: f"round({x}, {digits})")
    cols = [f"{shown(ratio('sum(tp)', 'sum(support)'))} AS accuracy"]
    cols += [f"{shown(f'max(CASE WHEN cls = {chr(39)}{c}{chr(39)} THEN f1 END)')} AS f1_{c}" for c in per_class]
    cols += [f"{shown('avg(f1)')} AS f1_macro",
             f"{shown(ratio('sum(f1 * support)', 'sum(support)'))} AS f1_weighted"]
    grp = f" GROUP BY {by}" if by else ""
    return f"SELECT {b}{', '.join(cols)} FROM (SELECT *, {f1} AS f1 FROM ({stats}) st) x{grp}"


def binary_eval(src: str, truth: str = "label", pred: str = "pred", by: str = "phase", digits: int | None = 6) -> str:
    b = f"{by}, " if by else ""
    conf = (f"(SELECT {b}y_true, y_pred, count(*) AS n FROM (SELECT {b}{encode(truth)} AS y_true, "
            f"{encode(pred)} AS y_pred FROM {src}) e GROUP BY {b}y_true, y_pred)")
    return summary(class_stats(conf, by), by, digits=digits)


def tokens(text: str = "text") -> str:
    return (f"list_filter(regexp_split_to_array(lower({text}), {sql_literal(TOKEN_SPLIT_PATTERN)}), "
            f"lambda x: x <> '')")
