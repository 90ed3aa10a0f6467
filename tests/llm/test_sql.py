"""The queries that have SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tidemark.llm.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, str(DATA))
    found = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr) == want
