"""Every registered query with SQL gives what DuckDB gives."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry_point
from martlib.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return f"{float(value):.9g}"
    return str(value).removesuffix(" 00:00:00")


def table_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


def compare(spark, sf_dir, name, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = entry_point.queries()[name](spark, sf_dir)
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    assert table_of(df.columns, [tuple(r) for r in df.collect()]) == table_of(names, got.fetchall())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    compare(spark, sf_dir, name, registry.ORACLE_SQL[name])


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
