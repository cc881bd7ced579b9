"""Fits: components, outliers, clusters, selection, model search. What they return has stable keys; figures come from fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandweave.functions import metrics
from bandweave.operators import covariates, features, prepare, tuning
from bandweave.operators import relational as rel
from bandweave.plans.catalog import r6, register, spectra, sql_round, table

AXIS = [600.0 + 2 * i for i in range(64)]
_TREES = 20


def _dataset(spark, sf_dir) -> DataFrame:
    """Spectra with a response that depends on them and a covariate."""
    rows = spectra(spark, sf_dir).withColumnRenamed("x", "spectrum").withColumnRenamed("sample_id", "Sample_ID")
    signal = 10 + 3 * F.get("spectrum", F.lit(10)) + 2 * F.get("spectrum", F.lit(30)) - F.get("spectrum", F.lit(50))
    return rows.withColumn("Response", signal).withColumn("depth", (F.col("Sample_ID") % 7).cast("double"))


@register("pca_scores")
def pca_scores(spark, sf_dir):
    rows = spectra(spark, sf_dir)
    return features.project(rows, "x", features.fit_projection(rows, "x", 0.95), "scores", AXIS).select("sample_id", F.transform("scores", lambda v: F.round(v, 4)).alias("scores"))


_X = "x AS (SELECT vec_id AS sample_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), l AS (SELECT sample_id, unnest(x) AS v, unnest(range(0, 64)) AS b FROM x), "


@register(
    "pca_gram",
    f"WITH {_X} z AS (SELECT sample_id, b, (v - avg(v) OVER (PARTITION BY b)) / stddev_samp(v) OVER (PARTITION BY b) AS z FROM l) "
    "SELECT p.sample_id, round(sum(p.z * q.z), 4) AS product FROM z p JOIN z q ON p.b = q.b AND q.sample_id = p.sample_id + 1 GROUP BY 1",
)
def pca_gram(spark, sf_dir):
    """All components: the scores' inner products are those of the standardised spectra."""
    rows = spectra(spark, sf_dir)
    scored = features.project(rows, "x", features.fit_projection(rows, "x", 1.0), "scores", AXIS).select("sample_id", "scores")
    after = scored.select((F.col("sample_id") - 1).alias("sample_id"), F.col("scores").alias("after"))
    product = F.aggregate(F.zip_with("scores", "after", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return scored.join(after, "sample_id").select("sample_id", F.round(product, 4).alias("product"))


@register(
    "pca_variances",
    f"WITH {_X} c AS (SELECT corr(p.v, q.v) AS r, p.b = q.b AS same FROM l p JOIN l q USING (sample_id) GROUP BY p.b, q.b) "
    "SELECT round(sum(r) FILTER (same), 6) AS variances, round(sum(r * r), 6) AS squares FROM c",
)
def pca_variances(spark, sf_dir):
    """The components' variances add up to the trace of the correlation matrix, their squares to that of its square."""
    found = features.fit_projection(spectra(spark, sf_dir), "x", 1.0).variances
    return spark.createDataFrame([(float(v),) for v in found], "v double").agg(r6(F.sum("v")).alias("variances"), r6(F.sum(F.col("v") * F.col("v"))).alias("squares"))


# Gauss-Jordan: 64 steps on the covariance matrix beside the identity
_INVERSE = """WITH RECURSIVE """ + _X + """m AS (SELECT list(v ORDER BY b) AS mean FROM (SELECT b, avg(v) AS v FROM l GROUP BY b)),
c AS (SELECT p.b AS i, q.b AS j, covar_samp(p.v, q.v) AS s FROM l p JOIN l q USING (sample_id) GROUP BY p.b, q.b),
r AS (SELECT i, list_concat(list(s ORDER BY j), list_transform(range(0, 64), lambda k: CASE WHEN k = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS w FROM c GROUP BY i),
g(k, a) AS (
  SELECT 1, list(w ORDER BY i) FROM r
  UNION ALL
  SELECT k + 1, list_transform(a, lambda w, i: CASE WHEN i = k THEN list_transform(w, lambda v: v / w[k])
    ELSE list_transform(w, lambda v, j: v - w[k] * a[k][j] / a[k][k]) END) FROM g WHERE k <= 64
), inv AS (SELECT list_transform(a, lambda w: w[65:128]) AS s FROM g WHERE k = 65),
d AS (SELECT sample_id, list_transform(x, lambda v, i: v - mean[i]) AS d FROM x, m),
f AS (SELECT sample_id, sqrt(list_sum(list_transform(d, lambda v, i: v * list_dot_product(d, s[i])))) AS distance FROM d, inv)
"""


#: The 0.975 quantile of chi-square with 64 degrees of freedom is 88.004.
@register("mahalanobis_outliers", _INVERSE + "SELECT sample_id, round(distance, 4) AS mahalanobis, distance > sqrt(88.004) AS spectral_outlier FROM f")
def mahalanobis_outliers(spark, sf_dir):
    """Over all components, where the distance is that in the bands' own covariance."""
    found = features.spectral_outliers(spectra(spark, sf_dir), "x", 0.975, 1.0)
    return found.select("sample_id", F.round("mahalanobis", 4).alias("mahalanobis"), "spectral_outlier")


@register("spectral_outliers")
def spectral_outliers(spark, sf_dir):
    return features.spectral_outliers(spectra(spark, sf_dir), "x", 0.975, 0.99).select("sample_id", F.round("mahalanobis", 4).alias("mahalanobis"), "spectral_outlier")


@register("finalized_dataset")
def finalized_dataset(spark, sf_dir):
    return prepare.finalize_dataset(_dataset(spark, sf_dir), "Response").select("Sample_ID", r6("Response").alias("Response"), "outlier_flag")


_RESPONSE = "r AS (SELECT vec_id AS \"Sample_ID\", 10 + 3 * embedding[11]::DOUBLE + 2 * embedding[31]::DOUBLE - embedding[51]::DOUBLE AS y FROM embeddings)"


@register(
    "finalized_responses",
    f"WITH {_RESPONSE}, p AS (SELECT * FROM r WHERE y > 0), f AS (SELECT quantile_cont(y, .25) AS a, quantile_cont(y, .75) AS b FROM p) "
    'SELECT "Sample_ID", round(y, 6) AS "Response", CASE WHEN y < a - (b - a) OR y > b + (b - a) THEN \'outlier\' ELSE \'good\' END AS outlier_flag FROM p, f',
)
def finalized_responses(spark, sf_dir):
    """Positive responses, flagged by their fences alone."""
    rows = prepare.finalize_dataset(_dataset(spark, sf_dir), "Response", None, response_cutoff=1.0, enforce_positive=True)
    return rows.select("Sample_ID", r6("Response").alias("Response"), "outlier_flag")


@register("created_dataset", "SELECT 'proj' AS \"Project\", vec_id::VARCHAR AS \"Sample_ID\", label, list_transform(embedding, lambda v: round(v::DOUBLE, 6)) AS spectrum, 1::BIGINT AS n_replicates, round(c_acctbal, 6) AS c_acctbal FROM embeddings JOIN customer ON vec_id = c_custkey")
def created_dataset(spark, sf_dir):
    scans = spectra(spark, sf_dir).select(F.concat(F.lit("proj_"), F.col("sample_id").cast("string"), F.lit("_S1.0")).alias("Sample_ID"), "label", F.col("x").alias("spectrum"))
    response = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("Sample_ID"), "c_acctbal")
    made = prepare.create_dataset(scans, response, ["c_acctbal"], parse_ids=True, id_format="project_sampleid_scanid")
    return made.select("Project", "Sample_ID", "label", F.transform("spectrum", lambda v: sql_round(v)).alias("spectrum"), "n_replicates", r6("c_acctbal").alias("c_acctbal"))


def _preprocessed(spark, sf_dir, interval: float, baseline: str, rounded=lambda v: F.round(v, 6)) -> DataFrame:
    from bandweave.operators.kernels import preprocess_spectra
    from bandweave.sources.readers import with_metadata

    rows = with_metadata(spectra(spark, sf_dir).withColumnRenamed("x", "spectrum"), wavenumbers=AXIS, spectra_type="NIR")
    return preprocess_spectra(rows, interval, baseline).select("sample_id", F.transform("spectrum", rounded).alias("spectrum"))


# the lower hull at a band is the lowest chord over it; every second band is a knot of the new axis
_HULL = """h AS (SELECT q.sample_id, q.b, min(CASE WHEN p.b = q.b THEN p.v ELSE p.v + (s.v - p.v) * (q.b - p.b) / (s.b - p.b) END) AS low
  FROM l q JOIN l p ON p.sample_id = q.sample_id AND p.b <= q.b JOIN l s ON s.sample_id = q.sample_id AND s.b >= q.b AND (s.b > p.b OR p.b = q.b) GROUP BY 1, 2) """


@register("preprocessed_spectra", f"WITH {_X}{_HULL}SELECT sample_id, list(round(v - low, 6) ORDER BY b) AS spectrum FROM l JOIN h USING (sample_id, b) WHERE b % 2 = 0 GROUP BY 1")
def preprocessed_spectra(spark, sf_dir):
    return _preprocessed(spark, sf_dir, 4.0, "rubberband")


# t and its square, each orthogonal to what comes before
_QUADRATIC = """z AS (SELECT sample_id, b, (v - avg(v) OVER w) / stddev_samp(v) OVER w AS z, b - 31.5::DOUBLE AS t FROM l WINDOW w AS (PARTITION BY sample_id)),
u AS (SELECT *, t * t - avg(t * t) OVER (PARTITION BY sample_id) AS s FROM z), k AS (SELECT sample_id, sum(z * t) / sum(t * t) AS c, sum(z * s) / sum(s * s) AS d FROM u GROUP BY 1) """


@register("detrended_spectra", f"WITH {_X}{_QUADRATIC}SELECT sample_id, list(round(z - c * t - d * s, 6) ORDER BY b) AS spectrum FROM u JOIN k USING (sample_id) GROUP BY 1")
def detrended_spectra(spark, sf_dir):
    """The polynomial baseline, on the spectra's own axis."""
    return _preprocessed(spark, sf_dir, 2.0, "polynomial", lambda v: sql_round(v))


@register("kmeans_clusters")
def kmeans_clusters(spark, sf_dir):
    rows = spectra(spark, sf_dir)
    scored = features.project(rows, "x", features.fit_projection(rows, "x", 0.5), "scores")
    clustered, _ = covariates.cluster_library(scored, "scores", 4)
    return clustered.groupBy(F.col("cluster").cast("long").alias("cluster")).agg(F.count("*").alias("n"))


def _selected(spark, sf_dir, kind: str, **settings) -> DataFrame:
    problem = tuning.collect_problem(_dataset(spark, sf_dir), "Response", preprocessing=("raw",))
    x, y = problem.spectra["raw"][problem.train], problem.y[problem.train]
    tasks = {"spark": spark} if kind == "boruta" else {}
    recipe = features.Recipe(kind, **settings, **tasks).fit(x, y)
    import numpy as np

    kept = recipe.apply(np.arange(x.shape[1], dtype=float)[None])[0]
    return spark.createDataFrame([(int(b),) for b in kept], "band long")


@register("boruta_bands")
def boruta_bands(spark, sf_dir):
    return _selected(spark, sf_dir, "boruta")


@register("cars_bands")
def cars_bands(spark, sf_dir):
    return _selected(spark, sf_dir, "cars")


@register("clustered_bands")
def clustered_bands(spark, sf_dir):
    import numpy as np

    problem = tuning.collect_problem(_dataset(spark, sf_dir), "Response", preprocessing=("raw",))
    chosen, members = features.cluster_predictors(problem.spectra["raw"], 10, axis=np.array(AXIS[4:-4]))
    return spark.createDataFrame([(int(c), len(m)) for c, m in zip(chosen, members, strict=True)], "band long, members long")


def _configs(spark, models) -> DataFrame:
    return rel.create_configs(spark, models, ("none",), ("snv_deriv1",), ("none",))


@register("model_search")
def model_search(spark, sf_dir):
    """Every model over one preprocessing, with the operators' own settings: grid, pruning, search, test metrics."""
    from bandweave.schema import MODELS

    problem = tuning.collect_problem(_dataset(spark, sf_dir), "Response", preprocessing=("snv_deriv1",))
    found = tuning.evaluate_configurations(spark, _configs(spark, MODELS), problem)
    return found.select("config_id", "workflow_id", "model", "status", "error_stage", F.round("rrmse", 4).alias("rrmse"), F.round("ccc", 4).alias("ccc"))


@register("bayes_search")
def bayes_search(spark, sf_dir):
    problem = tuning.collect_problem(_dataset(spark, sf_dir), "Response", preprocessing=("raw",), v=3)
    grid = rel.create_configs(spark, ("elastic_net", "plsr"), ("none", "log"), ("raw",), ("none", "pca"))
    found = tuning.evaluate_configurations(spark, grid, problem, 3, 4, False, trees=_TREES)
    return found.select("config_id", "workflow_id", "status", F.round("rrmse", 4).alias("rrmse"), F.size("best_params").cast("long").alias("n_params"))


@register("linear_fits", f"WITH {_RESPONSE} SELECT m.model, \"Sample_ID\"::VARCHAR AS row_id, round(y, 3) AS truth, round(y, 3) AS pred FROM r, (VALUES ('elastic_net'), ('plsr')) m(model)")
def linear_fits(spark, sf_dir):
    """The response is linear in the bands: fits without penalty, or with all components, give it back on rows held out,
    by folds for the training rows and at the end for the test rows."""
    problem = tuning.collect_problem(_dataset(spark, sf_dir), "Response", preprocessing=("raw",), v=3)
    settings = {"elastic_net": {"penalty": 1e-12, "mixture": 0.05}, "plsr": {"num_comp": 56}}
    configs = [{"config_id": m, "workflow_id": m, "model": m, "transformation": "none", "preprocessing": "raw", "feature_selection": "none", "covariates": []} for m in settings]
    rows = tuning.predictions_of(spark, configs, list(settings.values()), problem)
    return rows.select("model", "row_id", F.round("truth", 3).alias("truth"), F.round("pred", 3).alias("pred"))


@register("final_ensemble")
def final_ensemble(spark, sf_dir):
    """Search, the best two refitted, ensembles of their cross-validated predictions by each method, and their test metrics."""
    from bandweave.operators.ensemble import METHODS, build_ensemble
    from bandweave.operators.runner import finalize_top

    problem = tuning.collect_problem(_dataset(spark, sf_dir), "Response", preprocessing=("raw",), v=3)
    found = tuning.evaluate_configurations(spark, rel.create_configs(spark, ("elastic_net", "plsr"), preprocessing=("raw",)), problem, 2, 0, False)
    results = spark.createDataFrame(found.collect(), found.schema)
    _, long = finalize_top(spark, results, problem, 2, bayes_iter=1)
    long = spark.createDataFrame(long.collect(), long.schema)
    parts = [long.where(F.col("kind") == k).select("row_id", "truth", "model", "pred") for k in ("cv", "test")]
    rows = [build_ensemble(*parts, method=m)["metrics"].select(F.lit(m).alias("method"), *[F.round(x, 4).alias(x) for x in metrics.METRICS]) for m in METHODS]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@register("soil_covariates")
def soil_covariates(spark, sf_dir):
    """Local models of two properties for all samples, from a library made of the same vectors."""
    library = _library(spark, sf_dir)
    rows = spectra(spark, sf_dir).select(F.col("sample_id").cast("string").alias("Sample_ID"), F.col("x").alias("spectrum", metadata={"wavenumbers": AXIS}))
    out = covariates.predict_soil_covariates(spark, rows, library, ["clay", "ph"])
    return out["predictions"].select("Sample_ID", F.round("clay", 3).alias("clay"), F.round("ph", 3).alias("ph"))


def _library(spark, sf_dir) -> dict:
    rows = spectra(spark, sf_dir)
    ident = F.col("sample_id").cast("string").alias("id.layer_uuid_txt")
    value = lambda i: 5 + 2 * F.get("x", F.lit(i))
    return {
        "location": rows.select(ident, F.lit(0.0).alias("layer.upper.depth_usda_cm")),
        "lab": rows.select(ident, value(10).alias("clay.tot_usda.a334_w.pct"), value(30).alias("ph.h2o_usda.a268_index")),
        "spectra": rows.select(ident, *[F.get("x", F.lit(i)).alias(f"scan_mir.{int(w)}_abs") for i, w in enumerate(AXIS)]),
    }


@register("library_properties", "SELECT vec_id::VARCHAR AS id, round(10 * (5 + 2 * embedding[11]::DOUBLE), 4) AS clay, round(5 + 2 * embedding[31]::DOUBLE, 4) AS ph FROM embeddings")
def library_properties(spark, sf_dir):
    rows = covariates.training_data(_library(spark, sf_dir), ["clay", "ph"])
    return rows.select("id", F.round("clay", 4).alias("clay"), F.round("ph", 4).alias("ph"))


_PLACES = "p AS (SELECT s_suppkey AS \"Sample_ID\", (s_suppkey % 5) / 24.0::DOUBLE AS lon, 40 + (s_suppkey % 3) / 24.0::DOUBLE AS lat FROM supplier)"
# cells in steps of a 24th of a degree; mean latitude of a cell's places; 365 days of two years
_CLIMATE = f"""WITH {_PLACES}, q AS (SELECT *, round_even(lon * 24, 0)::BIGINT AS cx, round_even(lat * 24, 0)::BIGINT AS cy FROM p),
c AS (SELECT cx, cy, avg(lat) AS lat FROM q GROUP BY 1, 2),
i AS (SELECT id, (id // 730) % 5 AS cx, 960 + id // 3650 AS cy, 2003 + (id % 730) // 365 AS y, id % 365 + 1 AS j FROM range(0, 10950) t(id)),
d AS (SELECT cx, cy, y, j, month(make_date(y::INT, 1, 1) + (j - 1)::INT) AS m, 10.0::DOUBLE + j % 10 AS t, (j % 4)::DOUBLE AS p, lat,
  .409::DOUBLE * cos(2 * pi() * (j - 173) / 365.0::DOUBLE) AS tilt FROM i JOIN c USING (cx, cy)),
e AS (SELECT *, greatest(.0023::DOUBLE * (t + 17.8::DOUBLE) * sqrt(10.0::DOUBLE) * (.0820::DOUBLE * 1440 / pi() * acos(-tan(radians(lat)) * tan(tilt))), 0) AS pet FROM d),
yearly AS (SELECT cx, cy, y, avg(t) AS t, sum(p) AS p, avg(pet) AS e, sum(greatest(t - 10, 0)) AS g FROM e GROUP BY 1, 2, 3),
mean AS (SELECT cx, cy, avg(t) AS "MAT", avg(p) AS "MAP", avg(e) AS "PET", avg(p) / avg(e) AS "AI", avg(g) AS "GDD" FROM yearly GROUP BY 1, 2),
monthly AS (SELECT cx, cy, y, m, sum(p) AS p FROM e GROUP BY 1, 2, 3, 4), months AS (SELECT cx, cy, m, avg(p) AS p FROM monthly GROUP BY 1, 2, 3),
season AS (SELECT cx, cy, 100 * stddev_samp(p) / avg(p) AS "Precip_Seasonality" FROM months GROUP BY 1, 2)
SELECT "Sample_ID", round("MAT", 4) AS "MAT", round("MAP", 4) AS "MAP", round("PET", 4) AS "PET", round("AI", 4) AS "AI", round("GDD", 4) AS "GDD", round("Precip_Seasonality", 4) AS "Precip_Seasonality"
FROM q LEFT JOIN mean USING (cx, cy) LEFT JOIN season USING (cx, cy)"""


@register("climate_covariates", _CLIMATE)
def climate_covariates(spark, sf_dir):
    out = covariates.climate_covariates(*_weather(spark, sf_dir))
    return out.select("Sample_ID", *[F.round(c, 4).alias(c) for c in covariates.CLIMATE])


@register("covariate_table", f'SELECT "Sample_ID", "AI", "MAP", "MAT" FROM ({_CLIMATE})')
def covariate_table(spark, sf_dir):
    """The wanted covariates of samples, by names in any case, joined to their ids."""
    points, daily = _weather(spark, sf_dir)
    made = covariates.fetch_covariates(spark, points, ["map", "MAT", "ai"], daily=daily)
    return made["covariates"].select("Sample_ID", *[F.round(c, 4).alias(c) for c in ("AI", "MAP", "MAT")])


@register("covariate_kinds", "SELECT * FROM (VALUES ('soil', 'clay'), ('soil', 'ph'), ('soil', 'total_nitrogen'), ('climate', 'MAT'), ('climate', 'Precip_Seasonality')) t(kind, name)")
def covariate_kinds(spark, sf_dir):
    kinds = covariates.classify(["Clay", "phh2o", "ph", "nitrogen", "n", "mat", "PRECIP_SEASONALITY"])
    return spark.createDataFrame([(k, n) for k, names in kinds.items() for n in names], "kind string, name string")


@register("neighbourhood_grid", "SELECT d.v AS prod_degree, t.v::DOUBLE AS num_terms FROM (VALUES (1.0::DOUBLE), (2.0)) d(v), range(8, 13) t(v) UNION ALL SELECT NULL, v::DOUBLE FROM range(1, 5) t(v)")
def neighbourhood_grid(spark, sf_dir):
    """Two whole steps either way, clipped: around a MARS point, and around the second of 30 components."""
    from bandweave.operators.models import param_space

    mars = tuning.neighbourhood({"prod_degree": 2.0, "num_terms": 10.0}, param_space("mars", 56))
    plsr = tuning.neighbourhood({"num_comp": 2.0}, param_space("plsr", 56))
    rows = [(p["prod_degree"], p["num_terms"]) for p in mars] + [(None, p["num_comp"]) for p in plsr]
    return spark.createDataFrame(rows, "prod_degree double, num_terms double")


def _weather(spark, sf_dir):
    """Places, and the landed daily rows of their cells."""
    k = F.col("s_suppkey")
    points = table(spark, sf_dir, "supplier").select(k.alias("Sample_ID"), ((k % 5) / 24.0).alias("Longitude"), (40 + (k % 3) / 24.0).alias("Latitude"))
    day = F.col("id") % 365 + 1
    daily = spark.range(0, 15 * 730).select((F.floor(F.col("id") / 730) % 5).alias("cell_x"), (960 + F.floor(F.col("id") / 3650)).alias("cell_y"), (2003 + F.floor((F.col("id") % 730) / 365)).cast("int").alias("year"), day.cast("int").alias("yday"), (F.lit(5.0) + day % 10).alias("tmin"), (F.lit(15.0) + day % 10).alias("tmax"), (day % 4).cast("double").alias("prcp"))
    return points, daily
