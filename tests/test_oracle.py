"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from tapeloom.plans.registry import ORACLE, QUERIES

#: Ten rounds of fx_msg: replacements twice.
D = "/root/testdata/sf0.01"
TABLES = "events lineitem".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    rel = duck.sql(ORACLE[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert ours == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
