"""Every registered query against its DuckDB oracle (the driver's check) at sf0.001."""

import hashlib
import math

import duckdb
import pytest

from __spark_entry__ import entry
from scorekit.plans.registry import all_oracles as oracle_sql
from scorekit.plans.registry import all_queries as queries
from scorekit.sources.tables import TABLES

from .conftest import SF_SMALL


def _digest(cols, rows):
    def norm(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return str(v)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha256("\n".join(sorted(
        "|".join(norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(n for n in queries() if not n.endswith("_distributed")))
def test_query_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(ocols, orows)


def test_earlier_names_are_the_same_queries():
    q, o = queries(), oracle_sql()
    for name in (n for n in q if n.endswith("_distributed")):
        plain = name.removesuffix("_distributed")
        assert q[name] is q[plain] and o[name] == o[plain]


def test_entry_lists_every_query():
    import __spark_entry__
    assert set(queries()) <= set(__spark_entry__.queries())
    assert set(oracle_sql()) <= set(__spark_entry__.oracle_sql())


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() > 0
    assert df.columns == ["Country", "Name", "Rating", "RatingCount", "credibility_score",
                          "country_rank"]
