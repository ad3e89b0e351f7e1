"""Every registered query against its DuckDB oracle on the smallest driver tables.

The driver runs the same comparison at sf0.01; this keeps it green locally.
"""

import pytest

from tools.oracle_check import TABLES, canon

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _keys():
    from __spark_entry__ import oracle_sql

    return sorted(oracle_sql())


def test_every_query_has_an_oracle():
    """The library's own queries; a subpackage's may be checked otherwise (``tests/llm``)."""
    from __spark_entry__ import oracle_sql
    from signalmart.plans.catalog import QUERIES

    assert set(QUERIES) <= set(oracle_sql())


@pytest.mark.parametrize("key", _keys())
def test_query_matches_oracle(spark, duck, key):
    from __spark_entry__ import oracle_sql, queries

    df = queries()[key](spark, SF_SMALL)
    cur = duck.execute(oracle_sql()[key])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(cur.fetchall(), dcols)


def test_entry_smoke(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.count() > 0 and "momentum_score" in df.columns
