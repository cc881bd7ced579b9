"""Baselines and resampling of spectra. Resampling and detrending are linear, so that each axis needs one matrix."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandweave.functions import spectral
from bandweave.sources.readers import axis, with_metadata

ARRAY = T.ArrayType(T.DoubleType())


def lower_hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The lower convex hull of the points, read off at every x (ascending)."""
    hull: list[int] = []
    for i in range(len(x)):
        while len(hull) > 1:
            a, b = hull[-2], hull[-1]
            if (y[b] - y[a]) * (x[i] - x[a]) >= (y[i] - y[a]) * (x[b] - x[a]):
                hull.pop()
            else:
                break
        hull.append(i)
    return np.interp(x, x[hull], y[hull])


def rubberband(values: np.ndarray, wavenumbers: np.ndarray) -> np.ndarray:
    """Each row minus its lower hull; rows with a non-finite value become NaN."""
    order = np.argsort(wavenumbers)
    x, out = wavenumbers[order], np.full(values.shape, np.nan)
    for i, row in enumerate(values):
        if np.isfinite(row).all():
            out[i, order] = row[order] - lower_hull(x, row[order])
    return out


def detrend(values: np.ndarray, wavenumbers: np.ndarray, degree: int = 2) -> np.ndarray:
    """Standard normal variate, then minus the fitted polynomial of the axis."""
    scaled = (values - values.mean(1, keepdims=True)) / values.std(1, ddof=1, keepdims=True)
    z = (wavenumbers - wavenumbers.mean()) / (np.ptp(wavenumbers) or 1.0)
    q = np.linalg.qr(np.vander(z, degree + 1))[0]
    return scaled - (scaled @ q) @ q.T


def spline_weights(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Matrix of the natural cubic spline through values on old, read off at new (linear beyond the ends)."""
    order = np.argsort(old)
    x, n = np.asarray(old, float)[order], len(old)
    if n < 3:
        base = np.stack([np.interp(new, x, e) for e in np.eye(n)], 1)
    else:
        h = np.diff(x)
        if (h <= 0).any():
            raise ValueError("wavenumbers repeat")
        a, b = np.eye(n), np.zeros((n, n))
        for i in range(1, n - 1):
            a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            b[i, i - 1 : i + 2] = 6 / h[i - 1], -6 / h[i - 1] - 6 / h[i], 6 / h[i]
        second = np.linalg.solve(a, b)
        at = np.clip(np.searchsorted(x, new) - 1, 0, n - 2)
        inside = np.clip(new, x[0], x[-1])
        t, eye = ((inside - x[at]) / h[at])[:, None], np.eye(n)
        hh = (h[at] ** 2)[:, None]
        base = (1 - t) * eye[at] + t * eye[at + 1] + hh / 6 * (((1 - t) ** 3 - (1 - t)) * second[at] + (t**3 - t) * second[at + 1])
        slope_low = (eye[1] - eye[0]) / h[0] - h[0] / 6 * (2 * second[0] + second[1])
        slope_high = (eye[-1] - eye[-2]) / h[-1] + h[-1] / 6 * (second[-2] + 2 * second[-1])
        base += np.minimum(new - x[0], 0)[:, None] * slope_low + np.maximum(new - x[-1], 0)[:, None] * slope_high
    out = np.empty_like(base)
    out[:, order] = base
    return out


@lru_cache(maxsize=32)
def _weights(old: tuple, new: tuple) -> np.ndarray:
    return spline_weights(np.array(old), np.array(new))


def target_axis(wavenumbers: list[float], interval: float = 2.0, spectra_type: str = "MIR") -> list[float]:
    """600 to 4000 for MIR, the data's own whole range for NIR, in steps of interval."""
    low, high = (600.0, 4000.0) if spectra_type == "MIR" else (float(np.ceil(min(wavenumbers))), float(np.floor(max(wavenumbers))))
    return [low + i * interval for i in range(int((high - low) / interval + 1e-9) + 1)]


def preprocess_spectra(spectra: DataFrame, resample_interval: float = 2.0, baseline_method: str = "none") -> DataFrame:
    """Baseline, then resampling; metadata stay, with the new axis. Rows of another length, or NULL, give NULL."""
    if baseline_method not in ("none", "rubberband", "polynomial"):
        raise ValueError(f"unknown baseline method {baseline_method!r}")
    if resample_interval <= 0:
        raise ValueError("resample_interval must be positive")
    meta = dict(spectra.schema["spectrum"].metadata)
    old = axis(spectra)
    new = target_axis(old, resample_interval, meta.get("spectra_type", "MIR"))

    @F.pandas_udf(ARRAY)
    def run(column):
        import pandas as pd

        weights, grid = _weights(tuple(old), tuple(new)), np.array(old)
        good = [i for i, v in enumerate(column) if v is not None and len(v) == len(old)]
        out: list = [None] * len(column)
        if good:
            x = np.stack([np.asarray(column.iloc[i], float) for i in good])
            if baseline_method == "rubberband":
                x = rubberband(x, grid)
            elif baseline_method == "polynomial":
                x = detrend(x, grid)
            y = x @ weights.T
            for k, i in enumerate(good):
                out[i] = y[k]
        return pd.Series(out)

    rows = spectra.withColumn("spectrum", run("spectrum"))
    return with_metadata(rows, **{**meta, "wavenumbers": new, "resample_interval": float(resample_interval), "baseline_method": baseline_method})


def row_quality(x: Column | str) -> dict[str, Column]:
    """Counts of NULL, NaN and infinite bands, the row's sum and standard deviation, and whether it is all zero or constant."""
    x = F.col(x) if isinstance(x, str) else x
    finite = F.filter(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    sd = spectral.sd(finite)
    return {
        "n_null": F.size(F.filter(x, lambda v: v.isNull())).cast("long"),
        "n_nan": F.size(F.filter(x, lambda v: F.isnan(v))).cast("long"),
        "n_inf": F.size(F.filter(x, lambda v: F.abs(v) == float("inf"))).cast("long"),
        "row_sum": F.aggregate(finite, F.lit(0.0), lambda a, v: a + v),
        "row_sd": sd,
        "all_zero": F.forall(finite, lambda v: v == 0),
        "constant": F.coalesce(sd < 1e-10, F.lit(True)),
    }


def library_preprocess(x: Column | str, smooth_window: int = 9, smooth_poly: int = 1, derivative_order: int = 0) -> Column:
    """Savitzky-Golay, then standard normal variate (the other order than snv_deriv); the polynomial is raised if too low."""
    return spectral.snv(spectral.sliding_dot(x, spectral.savgol_kernel(smooth_window, max(smooth_poly, derivative_order), derivative_order)))
