"""The registered queries over the test tables and their SQL oracles.

A row of embeddings is a spectrum: sample_id is vec_id, and band i has the wavenumber 600 + 2 i.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
_PARTS = ("relational_queries", "spectral_queries", "model_queries")


def register(name: str, oracle: str | None = None):
    """Decorator: adds a query, with its oracle where SQL can express it."""

    def add(function):
        _QUERIES[name] = function
        if oracle is not None:
            _ORACLES[name] = oracle
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("sample_id"), "label", F.col("embedding").cast("array<double>").alias("x"))


def r6(column: Column | str) -> Column:
    return F.round(column, 6)


def sql_round(x: Column, digits: int = 6) -> Column:
    """Half away from zero in doubles, bit for bit as the SQL rounds: a small negative number becomes -0.0 (0.0 by F.round)."""
    scaled = x * F.lit(10.0**digits)
    near = F.rint(scaled)  # ties go to the even neighbour
    out = F.when(F.abs(scaled - near) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(near) / F.lit(10.0**digits)
    return F.when(F.isnan(out) | (F.abs(out) == float("inf")), x).otherwise(out)


def _load() -> None:
    for part in _PARTS:
        importlib.import_module(f"bandweave.plans.{part}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
