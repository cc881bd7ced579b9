"""Rounded spectra have the SQL's very bits: small negative values become -0.0 there."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from bandweave.plans import catalog

SPECTRAL = [f"spectral_{n}" for n in ("raw", "sg", "deriv1", "deriv2", "snv_deriv1", "snv_deriv2")]


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """Spectra of three levels and ramps, with noise around the last decimal, and customers for them."""
    rng, sf = np.random.default_rng(5), tmp_path_factory.mktemp("small")
    shapes = [np.repeat([1.0, 0.0, -1.0], [21, 22, 21]), np.linspace(0, 1, 64)]
    vectors = [shapes[i % 2] + rng.normal(0, 4e-7, 64) for i in range(40)]
    rows = {"vec_id": list(range(40)), "embedding": pa.array([v.tolist() for v in vectors], pa.list_(pa.float64())), "label": pa.array([i % 3 for i in range(40)], pa.int32())}
    pq.write_table(pa.table(rows), f"{sf}/embeddings.parquet")
    pq.write_table(pa.table({"c_custkey": list(range(40)), "c_acctbal": [i / 4 for i in range(40)]}), f"{sf}/customer.parquet")
    return str(sf)


def test_sql_round_has_the_bits_of_sql(spark):
    values = [0.0, -0.0, -1e-7, 1e-7, -4.9e-7, -5e-7, 5e-7, 2.5e-6, 0.0078125, -0.0078125, 0.0234375, -1.2345675, 0.49999999999999994e-6, 1e300, -1e306, float("inf"), float("-inf"), float("nan"), None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in rows.orderBy("i").select(catalog.sql_round(rows["v"])).collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    assert list(map(repr, got)) == list(map(repr, want))


def held_against_sql(spark, sf, name, key):
    con = duckdb.connect()
    for table in ("embeddings", "customer"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = dict(con.execute(f'SELECT "{key}", spectrum FROM ({catalog.oracle_sql()[name]})').fetchall())
    got = {r[key]: r["spectrum"] for r in catalog.queries()[name](spark, sf).collect()}
    assert any(repr(v) == "-0.0" for row in want.values() for v in row)
    assert {k: list(map(repr, v)) for k, v in got.items()} == {k: list(map(repr, v)) for k, v in want.items()}


@pytest.mark.parametrize("name", SPECTRAL)
def test_transforms_have_the_bits_of_sql(spark, small, name):
    held_against_sql(spark, small, name, "sample_id")


@pytest.mark.parametrize("name", [*SPECTRAL, "spectral_snv"])
def test_odd_spectra_equal_sql(spark, tmp_path, name):
    """Constant, zero, empty and short vectors, null bands and bands that are no numbers; sums whose last bit decides the sign of a zero."""
    rng = np.random.default_rng(7)
    ramp = rng.normal(0, 1, 64)
    odd = [None, [], [1.0], [1.0, 2.0, 4.0], [3.0] * 8, [3.0] * 12, [0.0] * 64, [0.1] * 64, [None] * 64, [None if i == 20 else v for i, v in enumerate(ramp)]]
    odd += [[x if i == 20 else v for i, v in enumerate(ramp)] for x in (float("nan"), float("inf"), float("-inf"))]
    odd += [[*np.round(rng.normal(0, 0.1, 30), 2), *rng.normal(0, 1e-7, 34)] for _ in range(2000)]
    vectors = pa.array([None if x is None else [None if v is None else float(v) for v in x] for x in odd], pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": list(range(len(odd))), "embedding": vectors, "label": pa.array([0] * len(odd), pa.int32())}), f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = dict(con.execute(f"SELECT sample_id, spectrum FROM ({catalog.oracle_sql()[name]})").fetchall())
    got = {r["sample_id"]: r["spectrum"] for r in catalog.queries()[name](spark, str(tmp_path)).collect()}
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in want.items()}


def test_preprocessed_library_has_the_bits_of_sql(spark, small):
    held_against_sql(spark, small, "library_preprocess", "sample_id")


def test_long_form_has_the_bits_of_sql(spark, small):
    held_against_sql(spark, small, "long_to_arrays", "sample_id")


def test_created_dataset_has_the_bits_of_sql(spark, small):
    held_against_sql(spark, small, "created_dataset", "Sample_ID")


def test_detrended_spectra_have_the_bits_of_sql(spark, small):
    held_against_sql(spark, small, "detrended_spectra", "sample_id")


def test_spectra_from_csv_have_the_bits_of_sql(spark, small):
    held_against_sql(spark, small, "spectra_from_csv", "Sample_ID")
