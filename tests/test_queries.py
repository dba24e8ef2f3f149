"""Every query with SQL gives the rows that DuckDB gives."""

import datetime
import math

import duckdb
import pytest

from quadrat import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat()[:10] if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, db, name):
    df = own.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
    cur = db.execute(own.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in cur.fetchall()), key=str)
    assert got == want


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
