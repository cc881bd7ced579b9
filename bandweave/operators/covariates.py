"""Covariates: soil properties predicted from a reference library's spectra, climate from daily cells, and their join.

The library is reshaped and projected once. Each property and cluster has a local model, fitted as a task of its own.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandweave import schema
from bandweave.functions import climate, metrics
from bandweave.operators import features, kernels, models, relational, tuning
from bandweave.sources.sinks import settled

CLIMATE = ("MAT", "MAP", "PET", "AI", "GDD", "Precip_Seasonality")
EXTRA_CLIMATE = ("Temperature_Range", "Frost_Days")


def validate_properties(properties: list[str]) -> list[str]:
    known = {p[0] for p in schema.SOIL_PROPERTIES}
    bad = [p for p in properties if p not in known]
    if bad:
        raise ValueError(f"unknown soil properties: {', '.join(bad)}; known: {', '.join(sorted(known))}")
    return properties


def training_data(library: dict[str, DataFrame], properties: list[str], max_samples: int | None = None, key: str = "id.layer_uuid_txt", depth: str = "layer.upper.depth_usda_cm", topsoil: bool = True, seed: int = 307) -> DataFrame:
    """(id, spectrum, one column per property) of library rows that have every property and a topsoil layer.

    library: location (id, depth), lab (id, wide values) and spectra (id, scan_mir.<n>_abs). Percent columns of weight
    become g/kg. The lab table is made long, named by the property map, and made wide again with one column per property.
    """
    validate_properties(properties)
    names = {p[4]: (p[0], 10.0 if p[3] == "g/kg" and p[4].endswith("w.pct") else 1.0) for p in schema.SOIL_PROPERTIES if p[0] in properties}
    lab, quoted = library["lab"], lambda c: F.col(f"`{c}`")
    present = [c for c in lab.columns if c in names]
    missing = set(properties) - {names[c][0] for c in present}
    if missing:
        raise ValueError(f"the library has no {', '.join(sorted(missing))}")
    values = lab.select(quoted(key).alias("id"), *[(quoted(c).cast("double") * names[c][1]).alias(names[c][0]) for c in present]).distinct()
    long = values.unpivot("id", properties, "property", "value").dropna(subset=["value"])
    wide = long.groupBy("id").pivot("property", properties).agg(F.avg("value")).dropna(subset=properties)
    where = library["location"].select(quoted(key).alias("id"), quoted(depth).alias("depth"))
    where = where.where("depth = 0") if topsoil else where
    bands = sorted((c for c in library["spectra"].columns if c.startswith("scan_mir.") and c.endswith("_abs")), key=lambda c: int(c.split(".")[1].split("_")[0]))
    axis = [float(c.split(".")[1].split("_")[0]) for c in bands]
    spectra = library["spectra"].select(quoted(key).alias("id"), F.array(*[quoted(b).cast("double") for b in bands]).alias("spectrum"))
    joined = wide.join(spectra, "id").join(where.select("id").distinct(), "id", "left_semi")
    joined = joined.where(F.forall("spectrum", lambda v: v.isNotNull() & ~F.isnan(v)))
    joined = relational.hashed_sample(joined, "id", max_samples, seed) if max_samples else joined
    return joined.withColumn("spectrum", F.col("spectrum").alias("spectrum", metadata={"wavenumbers": axis}))


def processed_training_data(library: dict[str, DataFrame], properties: list[str], variance: float = 0.95, **options) -> tuple[DataFrame, features.Projection]:
    """training_data with smoothed, scaled spectra and their component scores, and the projection."""
    rows = training_data(library, properties, **options)
    axis = rows.schema["spectrum"].metadata["wavenumbers"][4:-4]
    rows = rows.withColumn("x", kernels.library_preprocess("spectrum"))
    projection = features.fit_projection(rows, "x", variance, True, axis)
    return features.project(rows, "x", projection), projection


def _silhouettes(x: np.ndarray, labelings: list[np.ndarray], start: int, end: int) -> np.ndarray:
    """By labeling, the silhouette widths of the rows from start to end added up; distances are made once for all."""
    kinds = [np.unique(v, return_inverse=True) for v in labelings]
    member = np.concatenate([(at[:, None] == np.arange(len(ks))).astype(float) for ks, at in kinds], 1)
    sizes, square, out = member.sum(0), (x**2).sum(1), np.zeros(len(labelings))
    edges = np.cumsum([0, *(len(ks) for ks, _ in kinds)])
    step = max(1, (1 << 21) // len(x))
    for first in range(start, end, step):
        block = x[first : min(end, first + step)]
        d = (-2 * block) @ x.T
        d += square[first : first + len(block), None]
        d += square
        np.maximum(d, 0, out=d)
        sums, rows = np.sqrt(d, out=d) @ member, np.arange(len(block))
        for i, (_, at) in enumerate(kinds):
            part, size, own = sums[:, edges[i] : edges[i + 1]], sizes[edges[i] : edges[i + 1]], at[first : first + len(block)]
            a = part[rows, own] / np.maximum(size[own] - 1, 1)
            other = part / size
            other[rows, own] = np.inf
            b = other.min(1)
            out[i] += np.where(size[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0).sum()
    return out


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette width by Euclidean distance, block by block."""
    return -1.0 if len(np.unique(labels)) < 2 else float(_silhouettes(x, [labels], 0, len(x))[0] / len(x))


def _assigned(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest center of each row, the first of equal ones."""
    d = (-2 * centers) @ x.T
    d += (centers**2).sum(1)[:, None]
    best, labels = d[0].copy(), np.zeros(len(x), np.int32)
    for c in range(1, len(d)):
        nearer = d[c] < best
        labels[nearer] = c
        np.minimum(best, d[c], out=best)
    return labels


def _from_start(x: np.ndarray, centers: np.ndarray, rounds: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(sum of squares within, centers that rows were last given to, centers) of k-means from given centers."""
    for _ in range(rounds):
        at, labels = centers, _assigned(x, centers)
        member = (labels == np.arange(len(centers))[:, None]).astype(float)
        size = member.sum(1)
        new = np.where(size[:, None] > 0, member @ x / np.maximum(size, 1)[:, None], centers)
        if np.allclose(new, centers):
            break
        centers = new
    return float(((x - centers[labels]) ** 2).sum()), at, centers


def _starts(n: int, k: int, rng: np.random.Generator, starts: int = 25) -> list[np.ndarray]:
    return [rng.choice(n, k, replace=False) for _ in range(starts)]


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, starts: int = 25, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    _, at, centers = min((_from_start(x, x[rows], rounds) for rows in _starts(len(x), k, rng, starts)), key=lambda found: found[0])
    return _assigned(x, at), centers


def ward(x: np.ndarray, k: int) -> np.ndarray:
    """Labels of a Ward tree (squared distances) cut to k, by nearest-neighbour chains."""
    n = len(x)
    centers, size, alive, chain, merges = x.copy(), np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            d = np.where(alive, ((centers - centers[a]) ** 2).sum(1) * size * size[a] / (size + size[a]), np.inf)
            d[a] = np.inf
            b = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[b]:
                b = chain[-2]
                break
            chain.append(b)
        height, chain = d[b], chain[:-2]
        a, b = min(a, b), max(a, b)
        merges.append((height, a, b))
        centers[a] = (size[a] * centers[a] + size[b] * centers[b]) / (size[a] + size[b])
        size[a] += size[b]
        alive[b] = False
    root = np.arange(n)
    for _, a, b in sorted(merges, key=lambda m: m[0])[: n - k]:
        root[root == root[b]] = root[a]
    return np.unique(root, return_inverse=True)[1]


def cluster_scores(x: np.ndarray, max_clusters: int = 10, method: str = "kmeans", seed: int = 307, spark: SparkSession | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(labels, centers) of the number of clusters with the widest mean silhouette; too few rows make one cluster. With spark
    each start of k-means and each part of the silhouettes is a task."""
    ks = range(2, min(max_clusters, len(x) // 3) + 1)
    labels = np.zeros(len(x), int)
    if spark is None or not ks:
        tried = [ward(x, k) if method == "ward" else kmeans(x, k, np.random.default_rng([seed, k]))[0] for k in ks]
        widths = [silhouette(x, v) for v in tried]
    else:
        shared = spark.sparkContext.broadcast(x)
        if method == "ward":
            tried = [ward(x, k) for k in ks]
        else:
            todo = [(k, rows) for k in reversed(ks) for rows in _starts(len(x), k, np.random.default_rng([seed, k]))]
            ends = tuning.in_tasks(spark, todo, lambda task: _from_start(shared.value, shared.value[task[1]], 100)[:2])
            own = {k: min((end for (size, _), end in zip(todo, ends, strict=True) if size == k), key=lambda found: found[0]) for k in ks}
            tried = [_assigned(x, own[k][1]) for k in ks]
        several = [i for i, v in enumerate(tried) if len(np.unique(v)) > 1]
        given = spark.sparkContext.broadcast([tried[i].astype(np.int32) for i in several])
        step = max(1, -(-len(x) // (8 * spark.sparkContext.defaultParallelism)))
        parts = tuning.in_tasks(spark, list(range(0, len(x), step)), lambda start: _silhouettes(shared.value, given.value, start, min(len(shared.value), start + step))) if several else []
        widths = [-1.0] * len(tried)
        for i, width in zip(several, np.sum(parts, 0) if several else (), strict=True):
            widths[i] = float(width / len(x))
    if widths:
        labels = tried[int(np.argmax(widths))]
    return labels, np.stack([x[labels == c].mean(0) for c in range(labels.max() + 1)])


def cluster_library(rows: DataFrame, scores: str = "scores", max_clusters: int = 10, seed: int = 307) -> tuple[DataFrame, DataFrame]:
    """Distributed k-means over all rows, the number of clusters by Spark's silhouette: (rows with cluster, centers)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = settled(rows)
    ready = rows.withColumn("_f", array_to_vector(scores))
    n, best = rows.count(), None
    for k in range(2, min(max_clusters, n // 3) + 1):
        model = KMeans(featuresCol="_f", predictionCol="cluster", k=k, seed=seed, maxIter=100).fit(ready)
        out = model.transform(ready)
        if out.select("cluster").distinct().count() < 2:
            continue
        width = ClusteringEvaluator(featuresCol="_f", predictionCol="cluster").evaluate(out)
        if best is None or width > best[0]:
            best = (width, out.drop("_f"), [c.tolist() for c in model.clusterCenters()])
    if best is None:
        return rows.withColumn("cluster", F.lit(0)), rows.sparkSession.createDataFrame([(0, [0.0])], "cluster int, center array<double>")
    return best[1], rows.sparkSession.createDataFrame(list(enumerate(best[2])), "cluster int, center array<double>")


def clustered_subsets(rows: DataFrame, value: str, key: str, prop: float = 0.85, seed: int = 307) -> DataFrame:
    """A training and test split inside each cluster."""
    return relational.stratified_split(rows, value, key, prop, seed, ["cluster"])


def library_pool(library: DataFrame, unknown: DataFrame, centers: DataFrame, percentile: float = 0.6, key: str = "id", scores: str = "scores") -> DataFrame:
    """Library rows near each cluster of unknowns: by Mahalanobis distance in the cluster's own covariance where it has
    more than k + 5 rows, else Euclidean. centers: cluster, center, whiten (array of arrays)."""

    def distance(center, whiten):
        shifted = F.zip_with(scores, center, lambda a, b: a - b)
        rows = F.transform(whiten, lambda w: F.aggregate(F.zip_with(w, shifted, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
        return F.sqrt(F.aggregate(rows, F.lit(0.0), lambda s, v: s + v * v))

    pairs = library.select(key, scores).crossJoin(F.broadcast(centers)).select(key, "cluster", distance(F.col("center"), F.col("whiten")).alias("distance"))
    return relational.coverage_filter(settled(pairs), percentile, ["cluster"])


def whitening(x: np.ndarray) -> np.ndarray:
    """Matrix w with |w d| the Mahalanobis distance of a difference d (pseudo-inverse); the identity for few rows."""
    n, k = x.shape
    if n <= k + 5:
        return np.eye(k)
    values, vectors = np.linalg.eigh(np.cov(x, rowvar=False).reshape(k, k))
    good = values > 1e-10 * max(values.max(), 1e-300)
    return (vectors[:, good] / np.sqrt(values[good])).T


FIT_SCHEMA = "property string, cluster int, part string, id string, truth double, pred double"


CUBIST_SPACE = {"committees": models.Param(5, 15, True), "neighbors": models.Param(0, 5, True), "max_rules": models.Param(25, 75, True)}


def local_folds(y: np.ndarray, folds: int, seed: int) -> np.ndarray:
    part = np.empty(len(y), int)
    part[np.lexsort((np.random.default_rng(seed).random(len(y)), np.searchsorted(np.quantile(y, [0.25, 0.5, 0.75]), y)))] = np.arange(len(y)) % min(folds, len(y) // 3)
    return part


def fit_local_cubists(spark: SparkSession, x: np.ndarray, pools: list[tuple[np.ndarray, np.ndarray, np.ndarray]], asked: np.ndarray, grid: int = 10, bayes_iter: int = 10, folds: int = 10, seed: int = 307, piece: int = 4000) -> list[np.ndarray | None]:
    """Predictions for the asked rows of each pool (rows of x, their values, asked rows) by its tuned model; None where
    there can be none. Committees 5-15, neighbours 0-5 and rules 25-75 go by the cross-validated RMSE. The pools are tuned
    together: every fold of every point is a task, and neighbours of a fold's rows are found once.
    """
    shared = spark.sparkContext.broadcast((x, pools, asked))
    parts = [local_folds(y, folds, seed) if len(y) >= 3 else None for _, y, _ in pools]
    usable = [i for i, part in enumerate(parts) if part is not None]

    def fold_of(i, k):
        whole, own, _ = shared.value
        rows, y, _ = own[i]
        inside = local_folds(y, folds, seed) != k
        return whole[rows[inside]], y[inside], whole[rows[~inside]], y[~inside]

    def neighbours(task):
        a, y, b, _ = fold_of(*task)
        scaler = models.Scaler(a, y)
        places, distances = models.nearest(scaler.x(b), scaler.x(a), int(CUBIST_SPACE["neighbors"].high))
        return task, (places.astype(np.int32), distances)

    near = spark.sparkContext.broadcast(dict(tuning.in_tasks(spark, [(i, k) for k in range(folds) for i in usable if k <= parts[i].max()], neighbours)))

    def squares(task):
        j, i, k, params = task
        try:
            a, y, b, t = fold_of(i, k)
            return j, float(((models.fit("cubist", a, y, params, seed).predict(b, near.value[i, k]) - t) ** 2).sum())
        except (ValueError, np.linalg.LinAlgError) as error:
            return j, f"{type(error).__name__}: {error}"

    def errors(points: list[tuple[int, dict]]) -> list:
        found: list[list] = [[] for _ in points]
        for j, value in tuning.in_tasks(spark, [(j, i, k, params) for k in range(folds) for j, (i, params) in enumerate(points) if k <= parts[i].max()], squares):
            found[j].append(value)
        wrong = [next((v for v in own if isinstance(v, str)), None) for own in found]
        return [ValueError(w) if w else math.sqrt(sum(own) / len(pools[i][1])) for w, own, (i, _) in zip(wrong, found, points, strict=True)]

    points = [(i, params) for i in usable for params in tuning.candidates(CUBIST_SPACE, grid, seed)]
    tried: dict[int, list] = {i: [] for i in usable}
    for (i, params), value in zip(points, errors(points), strict=True):
        tried[i].append((params, value))
    searches = {i: tuning.proposals(CUBIST_SPACE, own, bayes_iter, 10, seed) for i, own in tried.items() if not any(isinstance(v, Exception) for _, v in own)}
    ends = tuning.search_together(searches, lambda given: dict(zip(given, errors(list(given.items())), strict=True)))
    best = {i: end[0] for i, end in ends.items() if not isinstance(end, Exception)}

    def answer(task):
        i, start = task
        whole, own, others = shared.value
        rows, y, ask = own[i]
        try:
            return models.fit("cubist", whole[rows], y, best[i], seed).predict(others[ask[start : start + piece]])
        except (ValueError, np.linalg.LinAlgError):
            return np.full(len(ask[start : start + piece]), np.nan)

    todo = [(i, start) for i in best for start in range(0, len(pools[i][2]), piece)]
    out: list = [None] * len(pools)
    for (i, _), guess in zip(todo, tuning.in_tasks(spark, todo, answer), strict=True):
        out[i] = guess if out[i] is None else np.concatenate([out[i], guess])
    return out


def _matrix(table, column: str = "scores") -> np.ndarray:
    return np.asarray(table[column].combine_chunks().flatten()).reshape(table.num_rows, -1)


def predict_soil_covariates(spark: SparkSession, samples: DataFrame, library: dict[str, DataFrame], properties: list[str], key: str = "Sample_ID", prop: float = 0.85, variance: float = 0.985, percentile: float = 0.6, coverage: float = 0.8, max_clusters: int = 10, method: str = "kmeans", grid: int = 10, bayes_iter: int = 10, folds: int = 10, seed: int = 307) -> dict:
    """Soil properties of samples (key, spectrum with an axis) from local models of the library.

    The samples' scores are clustered; each cluster takes its pool of near library rows, of which the nearest share is
    kept, split by quartiles and fitted, in tasks by property, cluster and fold. A pool under 30 rows has no model and its
    samples get NULL. Returns predictions (key, one column per property) and metrics (pooled validation by property).
    """
    import pyarrow as pa

    validate_properties(properties)
    rows, projection = processed_training_data(library, properties, variance)
    rows = settled(rows.select("id", *properties, "scores").where("scores IS NOT NULL"))
    axis = samples.schema["spectrum"].metadata["wavenumbers"]
    own = samples.select(F.col(key).alias("id"), kernels.library_preprocess("spectrum").alias("x"))
    own = features.project(own, "x", projection, "scores", axis[4:-4]).select("id", "scores").where("scores IS NOT NULL")
    found = own.orderBy("id").withColumn("id", F.col("id").cast("string")).toArrow()
    x, ids = _matrix(found), np.asarray(found["id"].to_pylist(), object)
    labels, centers = cluster_scores(x, max_clusters, method, seed, spark)
    table = [(c, centers[c].tolist(), whitening(x[labels == c]).tolist()) for c in range(len(centers))]
    places = spark.createDataFrame(table, "cluster int, center array<double>, whiten array<array<double>>")
    pool = relational.coverage_filter(library_pool(rows, own, places, percentile), coverage)
    joined = pool.join(rows.select("id", *properties), "id").unpivot(["id", "cluster"], properties, "property", "value")
    split = relational.stratified_split(joined, "value", "id", prop, seed, ["property", "cluster"])
    dealt = split.select("property", "cluster", F.col("id").cast("string").alias("id"), F.col("value").cast("double").alias("value"), (F.col("split") == "train").alias("train")).toArrow().to_pandas()
    kept = rows.select(F.col("id").cast("string").alias("id"), "scores").toArrow()
    scores, place = _matrix(kept), {v: i for i, v in enumerate(kept["id"].to_pylist())}
    dealt["at"] = dealt["id"].map(place)
    pieces, asks, pools, groups = [], [], [], {g: v.sort_values("id") for g, v in dealt.groupby(["property", "cluster"])}
    for name in properties:
        for c in range(len(centers)):
            group, mine = groups.get((name, c), dealt[:0]), np.flatnonzero(labels == c)
            train, test = group[group["train"]], group[~group["train"]]
            usable = len(train) and len(group) >= 30
            pools.append((train["at"].to_numpy(int), train["value"].to_numpy(float), np.concatenate([test["at"].to_numpy(int), len(scores) + mine])) if usable else (np.zeros(0, int), np.zeros(0), np.zeros(0, int)))
            asks.append((name, c, test, mine))
    for (name, c, test, mine), guess in zip(asks, fit_local_cubists(spark, scores, pools, np.concatenate([scores, x]), grid, bayes_iter, folds, seed), strict=True):
        n = len(test) + len(mine)
        guess = np.full(n, np.nan) if guess is None else guess
        truth = np.concatenate([test["value"].to_numpy(float), np.full(len(mine), np.nan)])
        columns = [pa.array([name] * n), pa.array(np.full(n, c, np.int32)), pa.array(["test"] * len(test) + ["unknown"] * len(mine)), pa.array([*test["id"], *ids[mine]], pa.string()), pa.array(truth, mask=np.isnan(truth)), pa.array(guess)]
        pieces.append(pa.table(columns, names=["property", "cluster", "part", "id", "truth", "pred"]))
    fitted = settled(spark.createDataFrame(pa.concat_tables(pieces), FIT_SCHEMA))
    clean = fitted.withColumn("pred", F.when(~F.isnan("pred"), F.col("pred")))
    return {
        "predictions": clean.where("part = 'unknown'").groupBy(F.col("id").alias(key)).pivot("property", properties).agg(F.first("pred")),
        "metrics": metrics.metrics_wide(clean.where("part = 'test'"), "truth", "pred", ["property"]),
        "clusters": spark.createDataFrame(pa.table([pa.array(ids, pa.string()), pa.array(labels.astype(np.int32))], names=[key, "cluster"]), f"`{key}` string, cluster int"),
    }


def climate_covariates(points: DataFrame, daily: DataFrame, key: str = "Sample_ID", longitude: str = "Longitude", latitude: str = "Latitude", start_year: int = 2003, end_year: int = 2024, gdd_base: float = 10.0) -> DataFrame:
    """(key, climate covariates) of points, from landed daily rows (cell_x, cell_y, year, yday, tmin, tmax, prcp).

    Each cell is summarised once. Cells without data give NULL. PET is a daily mean and AI the yearly sum of
    precipitation over it. Temperature_Range is the mean yearly spread of monthly temperatures, Frost_Days the mean yearly
    days below zero.
    """
    from bandweave.sources.readers import climate_rows

    cells = relational.cell_centroids(points.where(F.col(longitude).between(-180, 180) & F.col(latitude).between(-90, 90)), longitude, latitude)
    rows = climate_rows(daily, cells, start_year, end_year).join(relational.small(cells.select("cell_x", "cell_y", "latitude")), ["cell_x", "cell_y"])
    cell = ["cell_x", "cell_y"]
    rows = rows.select(
        *cell, "year", F.month(climate.day_of("year", "yday")).alias("month"), ((F.col("tmin") + F.col("tmax")) / 2).alias("temperature"),
        F.col("prcp").alias("precipitation"), climate.pet("latitude", "yday", "tmin", "tmax").alias("pet"), (F.col("tmin") < 0).cast("int").alias("frost"),
    )
    annual = relational.annual_climate(rows, cell, gdd_base)
    season = relational.precipitation_seasonality(rows, cell)
    monthly = rows.groupBy(*cell, "year", "month").agg(F.avg("temperature").alias("t"), F.sum("frost").alias("f"))
    extra = monthly.groupBy(*cell, "year").agg((F.max("t") - F.min("t")).alias("r"), F.sum("f").alias("f")).groupBy(*cell).agg(F.avg("r").alias("Temperature_Range"), F.avg("f").alias("Frost_Days"))
    summary = annual.join(season, cell, "left").join(extra, cell, "left")
    keyed = points.select(F.col(key), climate.cell_index(longitude).alias("cell_x"), climate.cell_index(latitude).alias("cell_y"))
    return keyed.join(relational.small(summary), cell, "left").select(key, *CLIMATE, *EXTRA_CLIMATE)


def classify(names: list[str]) -> dict[str, list[str]]:
    """Covariate names by kind, case aside, with aliases resolved; unknown and spatial ones are errors."""
    soil = {p[0].lower(): p[0] for p in schema.SOIL_PROPERTIES}
    weather = {c.lower(): c for c in schema.CLIMATE_COVARIATES}
    out: dict[str, list[str]] = {"soil": [], "climate": []}
    for name in names:
        low = schema.SOIL_ALIASES.get(name.lower(), name.lower())
        if low in soil:
            out["soil"].append(soil[low])
        elif low in weather:
            out["climate"].append(weather[low])
        elif low in {s.lower() for s in schema.SPATIAL_COVARIATES}:
            raise ValueError(f"spatial covariate {name} is not supported")
        else:
            raise ValueError(f"unknown covariate {name}")
    return {k: list(dict.fromkeys(v)) for k, v in out.items()}


def check_coordinates(points: DataFrame, longitude: str = "Longitude", latitude: str = "Latitude") -> None:
    bad = points.where(~(F.col(longitude).between(-180, 180) & F.col(latitude).between(-90, 90)))
    if not bad.isEmpty():
        raise ValueError("coordinates are out of range")


def fetch_covariates(spark: SparkSession, samples: DataFrame, names: list[str] | None = None, configs: DataFrame | None = None, library: dict[str, DataFrame] | None = None, daily: DataFrame | None = None, key: str = "Sample_ID", cache_dir: str | None = None, refresh: bool = False, **soil_options) -> dict:
    """All wanted covariates of samples in one table: ids, then soil, then climate, each left-joined.

    Wanted are names or what configs use. With cache_dir a table is kept under a digest of the samples and parameters.
    """
    from bandweave.sources.readers import digest_of
    from bandweave.sources.sinks import write_table

    if names is None:
        if configs is None:
            raise ValueError("either names or configs are needed")
        names = sorted(r[0] for r in configs.select(F.explode("covariates")).distinct().collect())
    kinds = classify(names)
    out = samples.select(key).distinct()
    made: dict = {"kinds": kinds, "cached": []}
    for kind, wanted in kinds.items():
        if not wanted:
            continue
        path = None
        if cache_dir:
            digest = hashlib.md5(f"{digest_of(samples)}{kind}{sorted(wanted)}{sorted(soil_options.items(), key=str)}".encode()).hexdigest()
            path = f"{cache_dir}/{kind}_{digest}"
        table = None
        if path and not refresh:
            from pyspark.errors import AnalysisException

            try:
                table = spark.read.parquet(path)
                made["cached"].append(kind)
            except AnalysisException:
                table = None
        if table is None:
            if kind == "soil":
                if library is None:
                    raise ValueError("soil covariates need a library")
                result = predict_soil_covariates(spark, samples, library, wanted, key, **soil_options)
                table, made["soil_metrics"] = result["predictions"], result["metrics"]
            else:
                if daily is None:
                    raise ValueError("climate covariates need daily rows")
                check_coordinates(samples)
                table = climate_covariates(samples, daily, key).select(key, *wanted)
            if path:
                write_table(table, path)
                table = spark.read.parquet(path)
        out = out.join(table, key, "left")
    made["covariates"] = out
    return made
