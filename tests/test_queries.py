"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as spark_entry
from vacantia.plans import oracle, registry

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# Models have no SQL form; their numbers are tested in test_models.py.
WITHOUT_SQL = {"wage_regression", "wage_mlp", "marginal_effects", "discover_wage_drivers"}
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def plain(rows):
    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return (0, "")
        return (1, repr(float(v)) if isinstance(v, float) else str(v))

    return sorted(tuple(value(v) for v in row) for row in rows)


def test_every_query_has_sql_but_the_models():
    assert set(registry.queries()) - set(SQL) == WITHOUT_SQL
    assert set(SQL) <= set(registry.queries()) <= set(spark_entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tables, name):
    result = spark_entry.queries()[name](spark, FOLDER)
    columns = sorted(result.columns)
    relation = tables.sql(SQL[name])
    assert sorted(relation.columns) == columns
    expected = relation.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert plain(result.select(*columns).collect()) == plain(expected)


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_model_queries_run(spark, name):
    assert spark_entry.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0
