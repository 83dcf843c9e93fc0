import sys

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def same(duck):
    """Whether a Spark frame and a DuckDB query have the same rows."""

    def check(df, sql):
        got = duck.execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns)
        assert _rows(df.columns, df.collect()) == _rows(names, got.fetchall())

    return check
