"""CLI: run every registered query against its oracle. ``python tests/run_oracle.py [sf_dir] [name...]``"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from oracle_harness import compare, duck  # noqa: E402

from labelwise.session import local_session  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session(8, 8)
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            r = compare(spark, name, fn, sql.get(name), sf_dir, con)
        except Exception as e:  # report and continue
            r = {"query": name, "error": f"{type(e).__name__}: {str(e)[:800]}"}
        r["sec"] = round(time.time() - t, 2)
        bad += r.get("match") is False or "error" in r
        print(json.dumps(r, ensure_ascii=False), flush=True)
    print(f"{len(qs)} queries, {len(sql)} with oracle, {bad} failing")


if __name__ == "__main__":
    main()
