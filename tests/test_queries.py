"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from packsieve.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def told(v):
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, oracle, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(tuple(told(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    cur = oracle.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    order = sorted(range(len(names)), key=names.__getitem__)
    assert mine == sorted(tuple(told(r[i]) for i in order) for r in cur.fetchall())


def test_entry_has_a_stable_schema(spark):
    rows = registry.flagship(spark, SF)
    assert rows.columns[:2] == ["probe_id", "candidate"] and rows.where("candidate = 'same'").select("verdict").distinct().collect()[0][0] == "strong_exact"
