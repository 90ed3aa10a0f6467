"""Every query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tidemark.plans.oracle import ORACLE_SQL
from tidemark.plans.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    rows = [tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect()]
    found = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    want = [tuple(plain(r[i]) for i in order) for r in found.fetchall()]
    assert sorted(names) == sorted(df.columns)
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
