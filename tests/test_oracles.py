"""Every registered query with SQL of its own, against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas
import pytest

from bandweave.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, (list, tuple)) or getattr(value, "ndim", 0):
        return [plain(v) for v in value]
    if hasattr(value, "item"):
        value = value.item()
    if value is None or value is pandas.NA or value != value:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 4) + 0.0 if math.isfinite(value) else float(value)
    return str(value)


def rows_of(frame, columns):
    return sorted(str([plain(v) for v in row]) for row in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows_of(got, columns) == rows_of(want, columns)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
