"""Every registered query against its SQL on the same tables."""

import duckdb
import pytest

import __spark_entry__
from codetide.workload import reference_sql, registry

QUERIES, SQL = registry.queries(), reference_sql.statements()


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "events"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def normal(value):
    return repr(round(value, 9)) if isinstance(value, float) else repr(value)


def test_every_statement_has_a_query():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_parity(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted("|".join(map(normal, row)) for row in df.select(*columns).collect())
    relation = con.execute(SQL[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted("|".join(normal(row[i]) for i in order) for row in relation.fetchall())
    assert got


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
