"""Every query of the core against its SQL."""

import duckdb
import pytest

from genoloom.plans.catalog import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def plain(v):
    return "null" if v is None else repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)


def rows(columns, values):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, data, name):
    df = QUERIES[name](spark, data)
    got = df.collect()
    assert got or name in ("unmatched_genes",)
    if name in ORACLE:
        rel = db.sql(ORACLE[name])
        assert sorted(rel.columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(rel.columns, rel.fetchall())


def test_entry_points():
    import __spark_entry__ as e

    assert set(ORACLE) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
