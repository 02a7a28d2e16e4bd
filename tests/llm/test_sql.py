"""Registered queries against their SQL over the smallest tables."""

import duckdb
import pytest

from quadrille.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in "documents pages conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, found = queries()[name](spark, SF), con.execute(oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(map(repr, (tuple(r[names.index(c)] for c in df.columns) for r in found.fetchall())))
    assert sorted(map(repr, map(tuple, df.collect()))) == want


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
