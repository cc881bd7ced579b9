"""Climate scalars: grid cells, evapotranspiration, degree days, dates of a year's days."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells of the daily climate grid per degree.
CELLS_PER_DEGREE = 24


def _as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def snapped(degrees: Column | str) -> Column:
    """Coordinate of the nearest cell; halves go to the even cell."""
    return F.bround(_as_column(degrees).cast("double") * CELLS_PER_DEGREE, 0) / CELLS_PER_DEGREE


def cell_index(degrees: Column | str) -> Column:
    """The cell as a whole number, which makes a safer key than its coordinate."""
    return F.bround(_as_column(degrees).cast("double") * CELLS_PER_DEGREE, 0).cast("long")


def grid_id(longitude: Column | str, latitude: Column | str) -> Column:
    return F.concat_ws("_", snapped(longitude).cast("string"), snapped(latitude).cast("string"))


def pet(latitude: Column | str, day: Column | str, low: Column | str, high: Column | str) -> Column:
    """Daily Hargreaves evapotranspiration, floored at zero; NULL where the sun does not set or rise."""
    phi = F.radians(_as_column(latitude))
    tilt = F.lit(0.409) * F.cos(F.lit(2 * math.pi) * (_as_column(day) - 173) / F.lit(365.0))
    cosine = -F.tan(phi) * F.tan(tilt)
    angle = F.when((cosine >= -1) & (cosine <= 1), F.acos(cosine))
    radiation = F.lit(0.0820 * 1440 / math.pi) * angle
    low, high = _as_column(low), _as_column(high)
    value = F.lit(0.0023) * ((low + high) / 2 + 17.8) * F.sqrt(F.greatest(high - low, F.lit(0.0))) * radiation
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def degree_days(temperature: Column | str, base: float = 10.0) -> Column:
    t = _as_column(temperature)
    return F.when(t.isNotNull(), F.greatest(t - base, F.lit(0.0)))


def day_of(year: Column | str, day: Column | str) -> Column:
    """Date of a year's day, the first being 1."""
    return F.date_add(F.make_date(_as_column(year), F.lit(1), F.lit(1)), _as_column(day).cast("int") - 1)
