"""The operators that SQL can express give DuckDB's rows on the small tables."""

import os

import duckdb
import pytest

from skein.llm import queries

SF = os.environ.get("SKEIN_TEST_SF", "/root/testdata/sf0.001")
TABLES = ("documents", "embeddings", "pages", "labels")


def plain(x):
    return repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_operator_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(queries.oracle_sql()[name])
    assert got == canonical([c[0] for c in cursor.description], cursor.fetchall())
