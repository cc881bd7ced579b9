"""From spectra and responses to a modelling dataset: identifiers, replicates, joins, outliers. All lazy but the PCA fit."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandweave.functions import text
from bandweave.operators import features, relational
from bandweave.schema import COORDINATE_COLUMNS
from bandweave.sources.readers import read_response

log = logging.getLogger("bandweave")


def create_dataset(spectra: DataFrame, response: str | DataFrame, response_variables: list[str] | None = None, id_column: str = "Sample_ID", parse_ids: bool = False, id_format: str | None = None, id_delimiter: str = "_", aggregate_by: list[str] | None = None, include_coords: bool = True, coord_columns: list[str] | None = None, join_type: str = "inner", drop_na: bool = True, report: bool = False) -> DataFrame:
    """Spectra joined with responses: ids parsed, replicates averaged, columns pruned, incomplete rows dropped.

    With parsing, replicates share all parsed parts but the scan, unless aggregate_by says otherwise. Without either,
    nothing is averaged. Coordinates are found by name. report logs how many rows of each side find no partner.
    """
    meta = spectra.schema["spectrum"].metadata
    rows, parsed = spectra, []
    if parse_ids:
        if not id_format:
            raise ValueError("parse_ids needs an id_format")
        parts = text.parse_file_name(F.col(id_column), id_format, id_delimiter)
        order = F.col(id_column)
        rows = rows.select("spectrum", order.alias("_file"), *[c.alias(n) for n, c in parts.items()], *[c for c in rows.columns if c not in {"spectrum", id_column, *parts}])
        if id_column != "Sample_ID":
            rows = rows.withColumnRenamed("Sample_ID", id_column)
        parsed = [id_column if n == "Sample_ID" else n for n in parts]
    by = aggregate_by or [c for c in parsed if c != "Scan"]
    if by:
        missing = [c for c in by if c not in rows.columns]
        if missing:
            raise ValueError(f"no such columns to average by: {', '.join(missing)}")
        order_by = "_file" if parse_ids else id_column
        rows = relational.spectra_average(rows, by, order_by)
        if id_column not in by and id_column not in rows.columns:
            raise ValueError(f"the averaged rows need {id_column}")
        rows = rows.drop("_file")
    table = read_response(spectra.sparkSession, response)
    coords = [c for c in table.columns if c in (coord_columns or COORDINATE_COLUMNS)] if include_coords else []
    wanted = response_variables or [c for c, t in table.dtypes if c != id_column and c not in coords and t in ("double", "float", "int", "bigint")]
    missing = [c for c in [id_column, *wanted] if c not in table.columns]
    if missing:
        raise ValueError(f"the response table has no {', '.join(missing)}")
    if report:
        left, right = relational.unmatched_counts(rows, table, id_column)
        log.info("%d spectra and %d responses have no partner", left, right)
    pruned = table.select(id_column, *[c for c in wanted + coords if c != id_column])
    clash = [c for c in pruned.columns if c != id_column and c in rows.columns]
    joined = relational.join_on(rows.drop(*clash), pruned, id_column, join_type)
    joined = joined.dropna(subset=wanted) if drop_na and wanted else joined
    return joined.withColumn("spectrum", F.col("spectrum").alias("spectrum", metadata=meta))


def finalize_dataset(dataset: DataFrame, response_variable: str, spectral_outlier_method: str | None = "mahalanobis", detect_response_outliers: bool = True, spectral_cutoff: float = 0.975, response_cutoff: float = 1.5, remove_outliers: bool = False, enforce_positive: bool = False, drop_na: bool = True) -> DataFrame:
    """Adds outlier_flag (good or outlier), from the spectra's distance and the response's fences, or drops the outliers."""
    if spectral_outlier_method not in (None, "none", "mahalanobis", "pca"):
        raise ValueError(f"unknown spectral outlier method {spectral_outlier_method!r}")
    if response_variable not in dataset.columns:
        raise ValueError(f"no column {response_variable}")
    meta = dataset.schema["spectrum"].metadata
    rows = dataset.dropna(subset=[response_variable]) if drop_na else dataset
    if enforce_positive:
        rows = rows.where(F.col(response_variable) > 0)
    if rows.limit(10).count() < 10:
        raise ValueError("at least ten rows are needed")
    if spectral_outlier_method in ("mahalanobis", "pca"):
        try:
            rows = features.spectral_outliers(rows, "spectrum", spectral_cutoff)
        except (ValueError, ArithmeticError) as error:
            log.warning("spectral outliers are skipped: %s", error)
    rows = relational.iqr_outliers(rows, response_variable, response_cutoff) if detect_response_outliers else rows
    flags = [F.col(c) for c in ("spectral_outlier", "response_outlier") if c in rows.columns]
    bad = F.lit(False)
    for f in flags:
        bad = bad | f
    rows = rows.withColumn("outlier_flag", F.when(bad, "outlier").otherwise("good")).drop("spectral_outlier", "response_outlier", "mahalanobis")
    rows = rows.where("outlier_flag = 'good'") if remove_outliers else rows
    return rows.withColumn("spectrum", F.col("spectrum").alias("spectrum", metadata=meta))
