"""Every query with SQL gives the rows that DuckDB gives, over the smallest driver tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else None if value is None else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"create view \"{name[:-8]}\" as select * from read_parquet('{FOLDER}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_rows_equal_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = Counter(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    other = duck.sql(entry.oracle_sql()[name])
    assert sorted(other.columns) == columns
    assert found == Counter(tuple(map(plain, r)) for r in other.select(*[f'"{c}"' for c in columns]).fetchall())


def test_every_query_has_a_stable_schema(spark):
    for name in ("verdict_failures", "requirement_sections", "extracted_symbols"):
        df = entry.queries()[name](spark, FOLDER)
        assert df.columns and df.count() >= 0
