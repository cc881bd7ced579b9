"""Sinks: results, checkpoints, error records and run metadata. Spark's committers make each write all or nothing."""

from __future__ import annotations

import uuid

import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("bandweave")


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for CSV."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    flat(df).write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_errors(results: DataFrame, path: str) -> None:
    """One JSON record for each failed configuration."""
    write_json(results.where("status = 'failed'"), path)


def write_metadata(spark: SparkSession, values: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(values, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def log_to(path: str) -> logging.Logger:
    """Appends time-stamped lines of the driver to a file."""
    handler = logging.FileHandler(path)
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.addHandler(handler)
    log.setLevel(logging.INFO)
    return log


def settled(df: DataFrame) -> DataFrame:
    """df as a table under spark.checkpoint.dir, so that it is worked out once and survives lost executors.

    Without that setting, as in tests, Spark's cache (memory and disk) stands in.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        return df.persist()
    path = f"{base.rstrip('/')}/bandweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
