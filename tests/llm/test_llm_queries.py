"""The training-text queries run and have the rows that DuckDB finds."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from canonry.llm.queries import QUERIES, SQL
from scripts.compare import plain


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name in SQL:
        cursor = duck.execute(SQL[name])
        described = [d[0] for d in cursor.description]
        assert sorted(described) == columns
        place = [described.index(c) for c in columns]
        assert Counter(rows) == Counter(tuple(plain(r[i]) for i in place) for r in cursor.fetchall())


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
