"""Every registered query against its DuckDB twin, over the smallest tables."""

import datetime

import duckdb
import pytest

from quaymark.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return round(float(v), 9) if isinstance(v, float) or hasattr(v, "is_finite") else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    if name in SQL:
        want = duck.execute(SQL[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(columns, want.fetchall())
    else:
        assert got


@pytest.mark.parametrize("name", ["fn_sector", "market_headlines"])
def test_words_of_headlines_end_where_the_sql_says(spark, tmp_path, name):
    words = ["ätech", "techñ und", "gasé", "oil_a", "x7bank", "M\u0130NER", "ban\u212a", "éshares", "sharesß", "rate9", "日market本", "Tech", ""]
    spark.createDataFrame([(11 * k + j, w) for k, w in enumerate(words) for j in range(11)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(SQL[name])
    got = QUERIES[name](spark, str(tmp_path))
    assert rows(got.columns, got.collect()) == rows([c[0] for c in want.description], want.fetchall())


def test_letters_of_all_scripts_are_parts_of_words(spark):
    from pyspark.sql import functions as F

    from quaymark.functions import scalars as S

    found = spark.createDataFrame([("ätech",), ("techñ shares",), ("Tech, éshares",)], "h string").select("h", S.sector(F.col("h")), S.market_relevant(F.col("h"))).collect()
    assert [tuple(r) for r in found] == [("ätech", "broad", False), ("techñ shares", "broad", True), ("Tech, éshares", "tech", False)]
