"""Queries whose result SQL can express, against their DuckDB form."""

import pytest

from scorekit.llm.queries import ORACLES, QUERIES

from .conftest import SF, rows_of


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in rows_of(df))
    assert got == sorted(map(str, want.fetchall()))
