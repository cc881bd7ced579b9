"""Feature selection and projection: as distributed expressions over all rows, and as numpy steps inside a model's task."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from bandweave.operators.relational import running_below, small

# distributed


def correlation_bands(rows: DataFrame, vector: str, outcome: str) -> DataFrame:
    """(band) that a window of three keeps: |Spearman correlation| with the outcome, averaged over three neighbours, at
    least a standard deviation above the windows' mean. All bands where no window passes or a correlation is undefined.

    Average ranks come from the distinct values of each band and of the outcome, put in order piece by piece.
    """
    outcomes = rows.groupBy(F.col(outcome).cast("double").alias("_y")).agg(F.count("*").alias("_n"))
    ranks = running_below(outcomes, [], "_y", "_n").select("_y", (F.col("_below") + (F.col("_n") + 1) / 2).alias("ry"))
    bands = rows.select(F.col(outcome).cast("double").alias("_y"), F.posexplode(vector).alias("band", "v"))
    pairs = bands.groupBy("band", "v", "_y").agg(F.count("*").alias("m")).join(small(ranks), "_y")
    values = bands.groupBy("band", "v").agg(F.count("*").alias("_n"))
    ranked = running_below(values, ["band"], "v", "_n").select("band", "v", (F.col("_below") + (F.col("_n") + 1) / 2).alias("rv"))
    weighted = pairs.join(ranked, ["band", "v"]).select("band", F.explode(F.array_repeat(F.struct("rv", "ry"), F.col("m").cast("int"))).alias("p")).select("band", "p.*")
    r = weighted.groupBy("band").agg(F.abs(F.corr("rv", "ry")).alias("r"))
    run = Window.orderBy("band").rowsBetween(0, 2)  # one row per band
    windows = r.withColumn("w", F.avg("r").over(run)).withColumn("k", F.count("r").over(run)).where("k = 3")
    cut = windows.agg((F.avg("w") + F.stddev_samp("w")).alias("cut"))
    kept = windows.crossJoin(F.broadcast(cut)).where("w >= cut").select(F.explode(F.array(*[F.col("band") + i for i in range(3)])).alias("band")).distinct()
    every = r.select("band")
    none = every.crossJoin(F.broadcast(kept.agg(F.count("*").alias("_n")))).where("_n = 0").select("band")
    return kept.join(every, "band", "left_semi").unionByName(none)


def interactions(vector: str | Column, covariates: list[str]) -> Column:
    """The products of every covariate with every element, covariate by covariate."""
    x = F.col(vector) if isinstance(vector, str) else vector

    def times(name: str) -> Column:
        return F.transform(x, lambda v: v * F.col(name))

    return F.flatten(F.array(*[times(c) for c in covariates]))


@dataclass
class Projection:
    """Principal components: (x - mean) / scale @ components, with the components' variances."""

    mean: np.ndarray
    scale: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    axis: list[float] | None = None

    def apply(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.components


def fit_projection(rows: DataFrame, vector: str, threshold: float = 0.95, scale: bool = True, axis: list[float] | None = None) -> Projection:
    """First components whose cumulative variance reaches the threshold; rows with a missing or NaN band are left out.

    Blocks of rows give their count, mean and centred products, which are merged pair by pair on the executors, as a tree.
    """
    clean = rows.where(F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v))).select(F.col(vector).cast("array<double>").alias("x"))

    def joined(a, b):
        if a is None or b is None:
            return b if a is None else a
        n, shift = a[0] + b[0], b[1] - a[1]
        return n, a[1] + shift * (b[0] / n), a[2] + b[2] + np.outer(shift, shift) * (a[0] * b[0] / n)

    def out(found):
        import pyarrow as pa

        if found is not None:
            n, mean, square = found
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tobytes()]), pa.array([square.tobytes()])], names=["n", "mean", "square"])

    def moments(batches):
        found = None
        for batch in batches:
            column = batch.column(0)
            width = len(column[0]) if len(column) else 0
            for start in range(0, len(column), 4096):
                x = column.slice(start, 4096).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                mean = x.mean(0)
                found = joined(found, (len(x), mean, (x - mean).T @ (x - mean)))
        yield from out(found)

    def merge(batches):
        found = None
        for batch in batches:
            for n, mean, square in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mean = np.frombuffer(mean)
                found = joined(found, (n, mean, np.frombuffer(square).reshape(len(mean), -1)))
        yield from out(found)

    kind = "n long, mean binary, square binary"
    parts, left = clean.mapInArrow(moments, kind), clean.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // 16)
        parts = parts.repartition(left).mapInArrow(merge, kind)
    got = parts.first()
    if got is None:
        raise ValueError("no whole rows")
    n, mean = got["n"], np.frombuffer(got["mean"])
    cov = np.frombuffer(got["square"]).reshape(len(mean), -1) / max(1, n - 1)
    sd = np.sqrt(np.maximum(np.diag(cov), 0)) if scale else np.ones(len(mean))
    sd = np.where(sd > 1e-12, sd, np.inf if scale else 1.0)
    return components_of(cov / np.outer(sd, sd), mean, sd, threshold, n, axis)


def components_of(cov: np.ndarray, mean: np.ndarray, sd: np.ndarray, threshold: float, n: int, axis: list[float] | None = None) -> Projection:
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    k = int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), threshold - 1e-12)) + 1
    k = min(k, max(1, n - 1), len(values))
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(values))] < 0, -1, 1)  # signs are fixed
    return Projection(mean, sd, vectors[:, :k], values[:k], axis)


def project(rows: DataFrame, vector: str, projection: Projection, into: str = "scores", axis: list[float] | None = None) -> DataFrame:
    """Adds the scores. With an axis of its own the vector is aligned to the projection's: missing bands are 0, others
    ignored; no common band is an error."""
    take = None
    if axis is not None and projection.axis is not None:
        at = {w: i for i, w in enumerate(axis)}
        take = [at.get(w, -1) for w in projection.axis]
        if max(take) < 0:
            raise ValueError("no band in common")

    def scores(column) -> list:
        good = [i for i, v in enumerate(column) if v is not None and len(v) >= (1 if take else len(projection.mean))]
        out: list = [None] * len(column)
        if good:
            x = np.stack([np.asarray(column[i], float) for i in good])
            if take is not None:
                x = np.where(np.array(take) >= 0, x[:, np.maximum(take, 0)], 0.0)
            for i, s in zip(good, projection.apply(x), strict=True):
                out[i] = s.tolist() if np.isfinite(s).all() else None
        return out

    rows = rows.drop(into)
    kept = T.StructType([*rows.schema.fields, T.StructField(into, T.ArrayType(T.DoubleType()))])
    at_vector = rows.columns.index(vector)

    def run(batches):  # a stage of its own: a UDF over array expressions with lambdas is not planned
        import pyarrow as pa

        for batch in batches:
            found = pa.array(scores(batch.column(at_vector).to_pylist()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, into])

    return rows.mapInArrow(run, kept)


def chi_square_quantile(p: float, df: int) -> float:
    """Inverse of the regularised lower incomplete gamma function, by bisection of its series."""

    def lower(a: float, x: float) -> float:
        if x <= 0:
            return 0.0
        if x < a + 1:
            term = total = 1 / a
            k = a
            while abs(term) > abs(total) * 1e-16:
                k += 1
                term *= x / k
                total += term
            return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
        tiny = 1e-300
        b, c = x + 1 - a, 1 / tiny
        d = 1 / b
        h = d
        for i in range(1, 10_000):
            an = -i * (i - a)
            b += 2
            d = 1 / (an * d + b or tiny)
            c = b + an / c or tiny
            h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return 1 - math.exp(-x + a * math.log(x) - math.lgamma(a)) * h

    low, high = 0.0, max(10.0, 4.0 * df)
    while lower(df / 2, high / 2) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if lower(df / 2, mid / 2) < p else (low, mid)
    return (low + high) / 2


def spectral_outliers(rows: DataFrame, vector: str, cutoff: float = 0.975, variance: float = 0.99) -> DataFrame:
    """rows with mahalanobis and spectral_outlier: the distance of the centred component scores beyond the root of the
    chi-square quantile. Rows that cannot be projected are no outliers."""
    projection = fit_projection(rows, vector, variance, scale=False)
    k, values = len(projection.variances), [float(v) for v in projection.variances]
    scored = project(rows, vector, projection, "_scores")
    terms = [F.pow(F.get("_scores", F.lit(i)), 2) / v for i, v in enumerate(values) if v > 1e-12]
    square = F.lit(0.0)
    for t in terms:
        square = square + t
    distance = F.sqrt(square)
    return scored.withColumn("mahalanobis", distance).withColumn("spectral_outlier", F.coalesce(F.col("mahalanobis") > math.sqrt(chi_square_quantile(cutoff, k)), F.lit(False))).drop("_scores")


# numpy steps of a model's task


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Column-wise average ranks."""
    out = np.empty(x.shape)
    for j in range(x.shape[1]):
        _, inverse, counts = np.unique(x[:, j], return_inverse=True, return_counts=True)
        out[:, j] = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    return out


def _corr_with(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    xc, yc = x - x.mean(0), y - y.mean()
    with np.errstate(invalid="ignore", divide="ignore"):
        return (xc * yc[:, None]).sum(0) / np.sqrt((xc**2).sum(0) * (yc**2).sum())


def select_correlation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Kept columns by the rule of correlation_bands."""
    r = np.abs(_corr_with(average_ranks(x), average_ranks(y[:, None])[:, 0]))
    if len(r) < 3 or not np.isfinite(r).all():
        return np.arange(x.shape[1])
    w = np.convolve(r, np.ones(3) / 3, "valid")
    keep = np.flatnonzero(w >= w.mean() + w.std(ddof=1)) if len(w) > 1 else np.array([], int)
    found = np.unique((keep[:, None] + np.arange(3)).ravel())
    return found if len(found) else np.arange(x.shape[1])


def average_linkage(distance: np.ndarray, k: int) -> np.ndarray:
    """Labels 0..k-1 of an average-linkage tree cut to k, by nearest-neighbour chains in O(n^2)."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, alive, chain, merges = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            row = np.where(alive, d[a], np.inf)
            b = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        a, b = min(a, b), max(a, b)
        merges.append((d[a, b], a, b))
        new = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a], d[:, a] = new, new
        d[a, a] = np.inf
        size[a] += size[b]
        alive[b] = False
    root = np.arange(n)
    for _, a, b in sorted(merges, key=lambda m: m[0])[: n - k]:
        ra, rb = root[a], root[b]
        root[root == rb] = ra
    _, labels = np.unique(root, return_inverse=True)
    return labels


def cluster_predictors(x: np.ndarray, k: int = 300, method: str = "correlation", axis: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """(representatives, members of each): columns clustered by 1 - |r| or by Euclidean distance. Fewer columns than k
    stay as they are. The member nearest the median of the axis stands for its cluster, without an axis the first."""
    p = x.shape[1]
    if p <= k:
        return np.arange(p), [np.array([i]) for i in range(p)]
    if method == "correlation":
        with np.errstate(invalid="ignore", divide="ignore"):
            r = np.nan_to_num(np.corrcoef(x, rowvar=False))
        distance = 1 - np.abs(r)
    else:
        square = (x**2).sum(0)
        distance = np.sqrt(np.maximum(square[:, None] + square - 2 * x.T @ x, 0))
    labels = average_linkage(distance, k)
    members = [np.flatnonzero(labels == c) for c in range(labels.max() + 1)]
    chosen = [m[0] if axis is None else m[np.abs(axis[m] - np.median(axis[m])).argmin()] for m in members]
    return np.array(chosen), members


def _expand(kept: np.ndarray, members: list[np.ndarray], p: int) -> np.ndarray:
    return np.sort(np.concatenate([members[i] for i in kept])) if len(kept) else np.arange(p)


def select_boruta(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, runs: int = 25, trees: int = 250, clusters: int = 50, axis: np.ndarray | None = None, spark=None) -> np.ndarray:
    """Boruta over clustered columns: a column is confirmed or rejected by how often its forest importance beats the best
    of its shuffled copies; tentative ones stay. Nothing confirmed or tentative: all columns. With spark, which only the
    driver has, trees are tasks."""
    from bandweave.operators.models import forest_importance

    varied = np.flatnonzero(x.var(0, ddof=1) > 1e-10)
    if not len(varied):
        return np.arange(x.shape[1])
    chosen, members = cluster_predictors(x[:, varied], min(clusters, len(varied)), axis=None if axis is None else axis[varied])
    base = x[:, varied][:, chosen]
    p = base.shape[1]
    mtry = max(1, min(max(5, round(2 * math.sqrt(p))), p - 1))
    hits, alive = np.zeros(p), np.ones(p, bool)
    try:
        for run in range(1, runs + 1):
            shadow = rng.permuted(base[:, alive], axis=0)
            importance = forest_importance(np.hstack([base[:, alive], shadow]), y, trees, mtry, rng, spark)
            best = importance[alive.sum() :].max()
            hits[alive] += importance[: alive.sum()] > best
            rejected = np.array([_binomial_tail(runs_done=run, hits=h) for h in hits]) < 0.01 / p
            alive &= ~rejected
            # the chance falls with the runs that are left and rises with hits: in the end these will be no less
            if not alive.any() or all(_binomial_tail(runs_done=runs, hits=h) >= 0.01 / p for h in hits[alive]):
                break
        kept = np.flatnonzero(alive)
    except (FloatingPointError, ValueError):
        kept = np.argsort(-np.abs(np.nan_to_num(_corr_with(base, y))))[:50]
    return varied[_expand(kept, members, len(varied))] if len(kept) else np.arange(x.shape[1])


def _binomial_tail(runs_done: int, hits: float) -> float:
    """Chance of at most so many hits under one half."""
    return sum(math.comb(runs_done, i) for i in range(int(hits) + 1)) / 2**runs_done


def select_cars(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, iterations: int = 50, clusters: int = 150, components: int = 5, axis: np.ndarray | None = None) -> np.ndarray:
    """Competitive adaptive reweighted sampling: on each Monte-Carlo sample a PLS fit ranks the columns, and an
    exponentially falling share of them goes on, drawn by weight; the set of lowest cross-validated error is kept."""
    from bandweave.operators.models import pls_coefficients

    n = len(y)
    chosen, members = cluster_predictors(x, min(clusters, x.shape[1]), axis=axis)
    base = x[:, chosen]
    p = base.shape[1]
    if p < 3 or n < 10:
        return np.arange(x.shape[1])
    fall = (p / 2) ** (1 / (iterations - 1))
    scale = base.std(0, ddof=1)
    z = (base - base.mean(0)) / np.where(scale > 1e-12, scale, np.inf)
    kept, best = np.arange(p), (np.inf, np.arange(p))
    parts = np.arange(n) % 5
    for i in range(1, iterations + 1):
        sample = rng.choice(n, int(0.8 * n), replace=False)
        k = min(components, len(kept))
        weight = np.abs(pls_coefficients(z[np.ix_(sample, kept)], y[sample], k))
        share = weight / max(weight.sum(), 1e-300)
        size = max(2, min(len(kept), round(p * fall ** -(i - 1))))
        kept = kept[np.argsort(-share)[:size]]
        share = np.sort(share)[::-1][:size]
        if share.sum() > 0 and (share > 0).sum() >= 2:
            kept = np.unique(kept[rng.choice(size, size, p=share / share.sum())])
        error = 0.0
        for part in range(5):
            hold = parts == part
            b = pls_coefficients(z[np.ix_(~hold, kept)], y[~hold], min(components, len(kept)))
            guess = y[~hold].mean() + (z[np.ix_(hold, kept)] - z[np.ix_(~hold, kept)].mean(0)) @ b
            error += ((guess - y[hold]) ** 2).sum()
        if error < best[0]:
            best = (error, kept)
        if len(kept) <= 2:
            break
    return _expand(best[1], members, x.shape[1])


class Recipe:
    """The steps of a configuration, learnt on training rows: selection or components, covariates, interactions.

    learn is a step of one's own in place of feature_selection: learn(x, y, rng, **settings) gives a function that turns
    a matrix of spectra into features, for the training rows and later for others.
    """

    def __init__(self, feature_selection: str = "none", covariate_interactions: bool = False, seed: int = 307, learn=None, **settings):
        if learn is None and feature_selection not in ("none", "pca", "correlation", "boruta", "cars"):
            raise ValueError(f"feature selection {feature_selection!r} is not supported")
        self.kind, self.interact, self.seed, self.learn, self.settings = feature_selection, covariate_interactions, seed, learn, settings

    def fit(self, x: np.ndarray, y: np.ndarray) -> Recipe:
        rng = np.random.default_rng(self.seed)
        if self.learn is not None:
            self.step = self.learn(x, y, rng, **self.settings)
        elif self.kind == "pca":
            sd = x.std(0, ddof=1)
            sd = np.where(sd > 1e-12, sd, np.inf)
            z = (x - x.mean(0)) / sd
            self.step = components_of(np.cov(z, rowvar=False).reshape(x.shape[1], x.shape[1]), x.mean(0), sd, 0.995, len(y)).apply
        elif self.kind == "none":
            self.step = lambda v: v
        else:
            columns = {"correlation": lambda: select_correlation(x, y), "boruta": lambda: select_boruta(x, y, rng, **self.settings), "cars": lambda: select_cars(x, y, rng, **self.settings)}[self.kind]()
            self.step = lambda v: v[:, columns]
        return self

    def apply(self, x: np.ndarray, covariates: np.ndarray | None = None) -> np.ndarray:
        out = self.step(x)
        if covariates is None or not covariates.shape[1]:
            return out
        products = [out * covariates[:, [j]] for j in range(covariates.shape[1])] if self.interact else []
        return np.hstack([out, covariates, *products])
