"""Compare a registered Spark query with its DuckDB oracle the way the driver does: row count, column
names, and an order-insensitive hash of the values (columns sorted by name)."""

from __future__ import annotations

import hashlib
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SF = {s: f"/root/testdata/sf{s}" for s in ("0.001", "0.01", "0.1")}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "asDict"):
        return _norm(tuple(v))
    return repr(v)


def digest(cols: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def compare(spark, name: str, fn, sql: str | None, sf_dir: str, con=None) -> dict:
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    out = {"query": name, "spark_rows": len(s_rows), "spark_cols": sorted(s_cols)}
    if sql is None:
        out["match"] = None
        return out
    con = con or duck(sf_dir)
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    out.update(oracle_rows=len(d_rows), oracle_cols=sorted(d_cols))
    out["match"] = (len(s_rows) == len(d_rows) and sorted(s_cols) == sorted(d_cols)
                    and digest(s_cols, s_rows) == digest(d_cols, d_rows))
    if not out["match"]:
        order_s = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
        order_d = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
        ss = sorted("|".join(_norm(r[i]) for i in order_s) for r in s_rows)
        dd = sorted("|".join(_norm(r[i]) for i in order_d) for r in d_rows)
        out["only_spark"] = [x[:300] for x in sorted(set(ss) - set(dd))[:3]]
        out["only_oracle"] = [x[:300] for x in sorted(set(dd) - set(ss))[:3]]
    return out
