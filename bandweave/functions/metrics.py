"""Regression metrics as aggregate columns: any grouping gets them in one pass with map-side partial sums.

All take the truth and the estimate and ignore pairs with a NULL or NaN in either. CCC and RPD follow the usual sample
(n - 1) moments; RRMSE divides by the mean of every usable truth, also of those without an estimate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16
#: metric -> whether larger is better
LARGER_IS_BETTER = {"rsq": True, "ccc": True, "rpd": True, "rmse": False, "rrmse": False, "mae": False}
METRICS = tuple(LARGER_IS_BETTER)


def _clean(x: Column | str) -> Column:
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    return F.when(~F.isnan(x), x)


def _pair(truth: Column | str, estimate: Column | str) -> tuple[Column, Column]:
    t, e = _clean(truth), _clean(estimate)
    whole = t.isNotNull() & e.isNotNull()
    return F.when(whole, t), F.when(whole, e)


def rmse(truth, estimate) -> Column:
    t, e = _pair(truth, estimate)
    return F.sqrt(F.avg((t - e) * (t - e)))


def mae(truth, estimate) -> Column:
    t, e = _pair(truth, estimate)
    return F.avg(F.abs(t - e))


def rsq(truth, estimate) -> Column:
    """Squared Pearson correlation; NULL if either side is constant or there are under two pairs."""
    t, e = _pair(truth, estimate)
    r = F.covar_samp(t, e)
    v = F.var_samp(t) * F.var_samp(e)
    return F.when(v > 0, r * r / v)


def ccc(truth, estimate) -> Column:
    """Concordance correlation; NULL under two pairs or if either side is constant."""
    t, e = _pair(truth, estimate)
    shift = F.avg(t) - F.avg(e)
    return F.when(
        (F.count(t) > 1) & (F.stddev_samp(t) >= EPS) & (F.stddev_samp(e) >= EPS),
        2 * F.covar_samp(t, e) / (F.var_samp(t) + F.var_samp(e) + shift * shift),
    )


def rpd(truth, estimate) -> Column:
    """Standard deviation of the truth over RMSE; infinite for a perfect fit, NULL for a single pair."""
    t, _ = _pair(truth, estimate)
    error = rmse(truth, estimate)
    return F.when(error < EPS, F.lit(float("inf"))).otherwise(F.stddev_samp(t) / F.when(error >= EPS, error))


def rrmse(truth, estimate) -> Column:
    """100 * RMSE / mean of all usable truths; infinite for a zero mean."""
    centre = F.avg(_clean(truth))
    error = rmse(truth, estimate)
    return F.when(error.isNotNull() & (centre == 0), F.lit(float("inf"))).otherwise(100 * error / F.when(centre != 0, centre))


def metric(name: str, truth, estimate) -> Column:
    if name not in LARGER_IS_BETTER:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}")
    return {"rmse": rmse, "mae": mae, "rsq": rsq, "ccc": ccc, "rpd": rpd, "rrmse": rrmse}[name](truth, estimate)


def metric_set(truth, estimate, metrics=METRICS) -> list[Column]:
    return [metric(m, truth, estimate).alias(m) for m in metrics]


def metrics_wide(df: DataFrame, truth: str, estimate: str, by: list[str] | None = None, metrics=METRICS) -> DataFrame:
    return df.groupBy(*(by or [])).agg(*metric_set(truth, estimate, metrics))


def metrics_long(df: DataFrame, truth: str, estimate: str, by: list[str] | None = None, metrics=METRICS) -> DataFrame:
    """(by, metric, estimator, estimate); groups with under two whole pairs give no rows."""
    by = by or []
    t, _ = _pair(truth, estimate)
    wide = df.groupBy(*by).agg(*metric_set(truth, estimate, metrics), F.count(t).alias("_pairs")).where("_pairs > 1")
    return wide.unpivot(by, list(metrics), "metric", "estimate").select(*by, "metric", F.lit("standard").alias("estimator"), "estimate")


def long_to_wide(long: DataFrame, by: list[str], metrics=METRICS) -> DataFrame:
    """The metrics are listed, so that the pivot needs no pass of its own."""
    return long.groupBy(*by).pivot("metric", list(metrics)).agg(F.first("estimate"))


def mean_and_error(long: DataFrame, by: list[str]) -> DataFrame:
    """Mean and standard error of each metric over folds."""
    return long.groupBy(*by, "metric").agg(F.avg("estimate").alias("mean"), (F.stddev_samp("estimate") / F.sqrt(F.count("estimate"))).alias("std_err"), F.count("estimate").alias("n"))


def rpd_band(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value.isNull(), F.lit(None)).when(value < 1.5, "poor").when(value < 2.0, "fair").when(value <= 2.5, "good").otherwise("excellent")


def ccc_band(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value.isNull(), F.lit(None)).when(value < 0.65, "poor").when(value < 0.80, "moderate").when(value <= 0.90, "substantial").otherwise("excellent")
