"""Every registered query outside tagloom.llm runs on the smallest tables and matches its oracle there."""

import duckdb
import pytest

from tagloom.plans.oracles import ORACLES
from tagloom.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return repr([plain(x) for x in v]) if isinstance(v, list | tuple) else repr(v)


def same(spark_rows, spark_columns, result):
    columns = [d[0] for d in result.description]
    want = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall())
    got = sorted(tuple(plain(r[c]) for c in sorted(spark_columns)) for r in spark_rows)
    assert sorted(columns) == sorted(spark_columns)
    assert got == want


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    rows = df.collect()
    assert rows
    if name in ORACLES:
        same(rows, df.columns, duck.execute(ORACLES[name]))


def test_registry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
