"""Every registered query against its DuckDB oracle at sf0.01 (as the driver checks it)."""

import pytest

import __spark_entry__ as E
from oracle_harness import SF, compare, duck

_Q = E.queries()
_SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF["0.01"])


@pytest.mark.parametrize("name", sorted(_Q))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, _Q[name], _SQL.get(name), SF["0.01"], con)
    if name in _SQL:
        assert r["match"], r
    else:
        assert r["spark_rows"] > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["phase", "accuracy", "f1_0", "f1_1", "f1_macro", "f1_weighted"]
    assert df.count() == 2
