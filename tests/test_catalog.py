"""Every query with SQL gives what DuckDB gives; every query runs."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(tables):
    from pathlib import Path

    c = duckdb.connect()
    for f in Path(tables).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(value, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_spark_equals_sql(spark, tables, con, name):
    df = QUERIES[name](spark, tables)
    cols = sorted(df.columns)
    got = sorted((tuple(value(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=str)
    r = con.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(value(row[i]) for i in at) for row in r.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_run(spark, tables, name):
    assert QUERIES[name](spark, tables).count() > 0


def test_entry(spark, tables):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
