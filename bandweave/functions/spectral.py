"""Row-wise transforms of a spectrum held as array<double>, as native column expressions."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

PREPROCESSING = ("raw", "sg", "snv", "deriv1", "deriv2", "snv_deriv1", "snv_deriv2")


def _as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column | str, body) -> Column:
    """body(x) with x evaluated once, however often the body uses it; NULL for a NULL x."""
    x = _as_column(x)
    return F.get(F.transform(F.when(x.isNotNull(), F.array(x)), lambda value: body(value)), F.lit(0))


def savgol_kernel(window: int, poly: int, order: int) -> list[float]:
    """Least-squares weights of the centred window's derivative coefficient (plain coefficient, not times order!).

    The normal equations are solved in fractions, so that the weights are the nearest doubles on every machine.
    """
    if window % 2 == 0 or window < 3:
        raise ValueError("window must be odd and at least 3")
    if not 0 <= order <= poly < window:
        raise ValueError("order <= poly < window is needed")
    offsets = range(-(window // 2), window // 2 + 1)
    size = poly + 1
    rows = [[Fraction(sum(t ** (i + j) for t in offsets)) for j in range(size)] + [Fraction(int(i == order))] for i in range(size)]
    for k in range(size):
        at = next(i for i in range(k, size) if rows[i][k])
        rows[k], rows[at] = rows[at], rows[k]
        rows[k] = [v / rows[k][k] for v in rows[k]]
        for i in range(size):
            if i != k:
                rows[i] = [v - rows[i][k] * p for v, p in zip(rows[i], rows[k], strict=True)]
    return [float(sum(rows[j][size] * t**j for j in range(size))) for t in offsets]


def trim(x: Column | str, window: int = 9) -> Column:
    """Drops (window - 1) / 2 bands at either end; too short a spectrum gives an empty array."""
    half = (window - 1) // 2
    return let(x, lambda v: F.slice(v, half + 1, F.greatest(F.size(v) - 2 * half, F.lit(0))))


def sliding_dot(x: Column | str, kernel: list[float]) -> Column:
    """Valid-mode dot product of each window with the kernel; the kernel is unrolled, so no inner lambda runs."""
    width = len(kernel)

    def over(v: Column) -> Column:
        starts = F.when(F.size(v) >= width, F.sequence(F.lit(0), F.size(v) - width)).otherwise(F.array().cast("array<int>"))

        def dot(i: Column) -> Column:
            total = None
            for j, weight in enumerate(kernel):
                if weight != 0.0:
                    term = F.get(v, i + j) * F.lit(float(weight))
                    total = term if total is None else total + term
            return total if total is not None else F.lit(0.0)

        return F.transform(starts, dot)

    return let(x, over)


def mean(x: Column | str) -> Column:
    return let(x, lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, e: a + e) / F.size(v)))


def sd(x: Column | str) -> Column:
    """Sample standard deviation of the elements (running mean and squares, in SQL's order); NULL under two elements."""

    def step(a: Column, e: Column) -> Column:
        n = a["n"] + 1.0
        return let(a["m"] + (e - a["m"]) / n, lambda m: F.struct(n.alias("n"), m.alias("m"), (a["q"] + (e - m) * (e - a["m"])).alias("q")))

    def of(v: Column) -> Column:
        zero = F.struct(*[F.lit(0.0).alias(c) for c in "nmq"])
        return F.when(F.size(v) > 1, F.sqrt(F.aggregate(v, zero, step, lambda a: a["q"]) / F.nullif(F.size(v) - 1, F.lit(0))))

    return let(x, of)


def snv(x: Column | str, flat: bool = False) -> Column:
    """Standard normal variate over the whole vector; a constant vector, or one with a NULL band, gives NULL.

    flat: as SQL has it, NULL bands stay beside the others, and a constant vector's bands are divided by zero.
    """

    def of(v: Column) -> Column:
        bands = F.filter(v, lambda e: e.isNotNull()) if flat else v
        stats = F.struct(mean(bands).alias("m"), sd(bands).alias("s"))
        if not flat:
            return let(stats, lambda t: F.when(t["s"] > 0, F.transform(v, lambda e: (e - t["m"]) / t["s"])))

        def scaled(e: Column, t: Column) -> Column:
            none = F.when(e > t["m"], float("inf")).when(e < t["m"], float("-inf")).when(e.isNotNull(), float("nan"))
            return F.when(t["s"] == 0, none).otherwise((e - t["m"]) / F.nullif(t["s"], F.lit(0.0)))

        return let(stats, lambda t: F.transform(v, lambda e: scaled(e, t)))

    return let(x, of)


def process(x: Column | str, preprocessing: str, window: int = 9, scale_derivative: bool = False, flat: bool = False) -> Column:
    """Applies one of PREPROCESSING; every result is window - 1 bands shorter than the input. flat: see snv."""
    if preprocessing not in PREPROCESSING:
        raise ValueError(f"unknown preprocessing {preprocessing!r}; known: {', '.join(PREPROCESSING)}")
    base = snv(x, flat) if preprocessing.startswith("snv") else _as_column(x)
    if preprocessing in ("raw", "snv"):
        return trim(base, window)
    if preprocessing == "sg":
        return sliding_dot(base, savgol_kernel(window, 1, 0))
    if preprocessing.endswith("deriv1"):
        return sliding_dot(base, savgol_kernel(window, 1, 1))
    return sliding_dot(base, [w * (2.0 if scale_derivative else 1.0) for w in savgol_kernel(window, 3, 2)])
