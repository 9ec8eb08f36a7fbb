"""All registered queries against their SQL on the same tables."""

import math

import pytest

import __spark_entry__ as entry
from slicewise.plans import oracles, queries

duckdb = pytest.importorskip("duckdb")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
CORE, CORE_SQL = queries.QUERIES, oracles.ORACLES


@pytest.fixture(scope="module")
def database(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    yield con
    con.close()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def normalized(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(plain(r[i]) for i in order) for r in records]
    return [columns[i] for i in order], sorted(table, key=repr)


def test_every_query_has_sql_or_a_reason():
    assert set(CORE) == set(CORE_SQL) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, sf_dir, database, name):
    df = QUERIES[name](spark, sf_dir)
    got = normalized(df.columns, [tuple(r) for r in df.collect()])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name not in ORACLES:
        return
    result = database.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert got == normalized(columns, result.fetchall())


def test_flagship(spark, sf_dir):
    df = entry.entry(spark)
    assert df.columns == ["artifact", "image", "n"] and df.count() > 0
