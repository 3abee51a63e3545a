"""Each query with SQL against DuckDB, over the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from stratia.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{entry.SMOKE}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "~" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, entry.SMOKE)
    result = duck.execute(registry.oracle_sql()[name])
    assert table(df.columns, df.collect()) == table([c[0] for c in result.description], result.fetchall())


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
