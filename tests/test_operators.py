import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandweave.operators import covariates, ensemble, features, models, prepare, relational, runner, tuning
from bandweave.sources import readers, sinks


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "s.csv").write_text("name,wn_650.5,wn_652\na,1.5,2\nb,x,3\n")
    rows = readers.read_spectra(spark, "csv", str(tmp_path / "s.csv"))
    assert readers.axis(rows) == [650.5, 652.0]
    assert {r["Sample_ID"]: r["spectrum"] for r in rows.collect()} == {"a": [1.5, 2.0], "b": [None, 3.0]}
    folder = tmp_path / "opus"
    folder.mkdir()
    (folder / "one.0").write_bytes(readers.write_opus([4000, 600], [0.1, 0.2, 0.3], "ab"))
    (folder / "two.1").write_bytes(readers.write_opus([4000, 600], [1, 2, 3], "sc_ref"))
    (folder / "bad.0").write_bytes(b"nothing")
    (folder / "note.txt").write_text("x")
    got = readers.read_spectra(spark, "opus", str(folder))
    assert {r["Sample_ID"] for r in got.collect()} == {"one", "two"} and readers.axis(got) == [4000.0, 2300.0, 600.0]
    for bad in (("xml", "x", "MIR"), ("csv", "x.txt", "MIR"), ("csv", "x.csv", "UV")):
        with pytest.raises(ValueError):
            readers.read_spectra(spark, *bad)
    sinks.write_csv(spark.createDataFrame([({"a": 1.0}, [1])], "m map<string,double>, l array<int>"), str(tmp_path / "out"))
    assert "m,l" in "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    sinks.write_metadata(spark, {"n": 1}, str(tmp_path / "meta"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "meta").glob("part*")))["n"] == 1
    one, two = spark.range(5), spark.range(5).repartition(3)
    assert readers.digest_of(one) == readers.digest_of(two) != readers.digest_of(spark.range(6))
    assert readers.cached_path(str(tmp_path), "none") is None


def scans(spark, n=40, bands=30, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(f"p_s{i}_S{k}.0", (rng.standard_normal(bands) + i / 10).tolist()) for i in range(n) for k in (1, 2)]
    return readers.with_metadata(spark.createDataFrame(rows, "Sample_ID string, spectrum array<double>"), wavenumbers=[600.0 + 2 * i for i in range(bands)])


def test_dataset_and_outliers(spark):
    response = spark.createDataFrame([(f"s{i}", float(i), 40.0, 10.0) for i in range(39)] + [("s39", 1000.0, 40.0, 10.0), ("s99", 1.0, 0.0, 0.0)], "Sample_ID string, SOC double, Latitude double, X double")
    made = prepare.create_dataset(scans(spark), response, parse_ids=True, id_format="project_sampleid_scanid")
    assert made.count() == 40 and {"n_replicates", "SOC", "Latitude", "Project"} <= set(made.columns)
    assert readers.axis(made)[0] == 600 and made.agg(F.max("n_replicates")).first()[0] == 2
    raw = {r["Sample_ID"]: np.array(r["spectrum"]) for r in scans(spark).collect()}
    assert np.allclose(made.where("Sample_ID = 's3'").first()["spectrum"], (raw["p_s3_S1.0"] + raw["p_s3_S2.0"]) / 2)
    final = prepare.finalize_dataset(made, "SOC")
    assert final.where("Sample_ID = 's39'").first()["outlier_flag"] == "outlier"
    assert prepare.finalize_dataset(made, "SOC", remove_outliers=True, enforce_positive=True).where("SOC <= 0 OR SOC = 1000").count() == 0
    with pytest.raises(ValueError):
        prepare.finalize_dataset(made.limit(5), "SOC")
    with pytest.raises(ValueError):
        prepare.create_dataset(scans(spark), response, ["missing"])


def test_zscore_join_and_grid(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "k string")
    covs = spark.createDataFrame([("a", 10.0, 1.0), ("b", 12.0, 1.0), ("c", 14.0, 1.0), ("d", 16.0, 1.0)], "k string, cov1 double, flat double")
    got = relational.zscore_join(rows, covs, "k")
    stats = got.agg(F.avg("cov1"), F.stddev_samp("cov1"), F.count("flat")).first()
    assert stats[0] == pytest.approx(0) and stats[1] == pytest.approx(1) and stats[2] == 0 and got.count() == 5
    assert relational.power_set(spark, ["a", "b"]).count() == 4
    grid = relational.create_configs(spark, ["plsr", "cubist"], ["none", "log"], ["raw", "sg"], ["none", "pca"], interactions=(False, True))
    assert grid.count() == 32 and grid.agg(F.min("config_id")).first()[0] == "config_0001"
    for bad in ({"feature_selection": ["pls"]}, {"spatial_covariates": ["slope"]}):
        with pytest.raises(ValueError):
            relational.create_configs(spark, **bad)


@pytest.mark.parametrize("p, df, want", [(0.975, 1, 5.0239), (0.975, 10, 20.4832), (0.5, 2, 1.3863)])
def test_chi_square(p, df, want):
    assert features.chi_square_quantile(p, df) == pytest.approx(want, abs=1e-4)


def test_projection_equals_svd(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 6)) @ rng.standard_normal((6, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "i int, x array<double>").repartition(3)
    found = features.fit_projection(rows, "x", 1.0)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    assert np.allclose(np.sort(found.variances), np.sort(np.linalg.svd(z, compute_uv=False) ** 2 / 199))
    got = {r["i"]: r["s"] for r in features.project(rows, "x", found, "s").collect()}
    assert got[999] is None and np.allclose(np.var([got[i] for i in range(200)], axis=0, ddof=1), found.variances)
    aligned = features.Projection(found.mean, found.scale, found.components, found.variances, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])
    with pytest.raises(ValueError):
        features.project(rows, "x", aligned, "s", [9.0])


def test_selection_finds_the_signal():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((120, 40))
    x[:, 11] = x[:, 10] + 0.1 * rng.standard_normal(120)
    x[:, 12] = x[:, 10] + 0.1 * rng.standard_normal(120)
    y = 3 * x[:, 10] + 0.3 * rng.standard_normal(120)
    assert {10, 11, 12} <= set(features.select_correlation(x, y)) and len(features.select_correlation(x, y)) < 20
    assert set(features.select_boruta(x, y, np.random.default_rng(0), 8, 20)) & {10, 11, 12}
    assert set(features.select_cars(x, y, np.random.default_rng(0), 20)) & {10, 11, 12}
    assert len(features.select_correlation(np.ones((20, 8)), np.arange(20.0))) == 8
    chosen, members = features.cluster_predictors(x, 38)
    assert len(chosen) == 38 and any({10, 11, 12} <= set(m) for m in members)
    with pytest.raises(ValueError):
        features.Recipe("pls")


@pytest.mark.parametrize("name", models.MODELS)
def test_models_beat_the_mean(name):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((160, 5))
    y = 2 * x[:, 0] - x[:, 1] + 5 + 0.1 * rng.standard_normal(160)
    params = {"svm_rbf": {"cost": 10.0, "rbf_sigma": 0.05}, "mlp_nn": {"hidden_units": 5, "epochs": 400}, "xgboost": {"learn_rate": 0.2, "tree_depth": 4}, "lightgbm": {"learn_rate": 0.2, "tree_depth": 4}, "elastic_net": {"penalty": 1e-4}}.get(name)
    guess = models.fit(name, x[:120], y[:120], params, trees=60).predict(x[120:])
    share = ((guess - y[120:]) ** 2).mean() / y[120:].var()
    assert share < (0.02 if name in ("plsr", "elastic_net", "mars", "cubist") else 0.5)


def test_bayes_search_and_candidates():
    space = {"a": models.Param(0, 1), "b": models.Param(-3, 1, log10=True)}
    points = tuning.candidates(space, 8)
    assert len({int(p["a"] * 8) for p in points}) == 8
    value = lambda p: (p["a"] - 0.3) ** 2 + (math.log10(p["b"]) + 1) ** 2 / 16
    start = [(p, value(p)) for p in points]
    _, best, rounds = tuning.bayes_search(space, value, start, 20)
    assert best <= min(v for _, v in start) and best < 0.01 and rounds <= 20
    assert len(tuning.neighbourhood(points[0], space, 25)) <= 25


def modelling_rows(spark, n=80):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((n, 20))
    y = 10 + 2 * x[:, 5] + x[:, 9] + 0.05 * rng.standard_normal(n)
    return spark.createDataFrame([(f"s{i}", v.tolist(), float(t), float(i % 5)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "Sample_ID string, spectrum array<double>, Response double, depth double")


def test_model_search_resumes_and_reports(spark, tmp_path):
    grid = relational.create_configs(spark, ("elastic_net", "plsr"), ("none", "log"), soil_covariates=())
    broken = grid.limit(1).select(F.lit("config_0009").alias("config_id"), F.lit("nope").alias("model"), *grid.columns[2:])
    out = str(tmp_path / "run")
    options = {"grid_size": 2, "bayes_iter": 1, "cv_folds": 3}
    first = runner.evaluate_models(spark, grid.limit(2).unionByName(broken), modelling_rows(spark), "Response", out, **options)
    states = {r["config_id"]: r["status"] for r in first.collect()}
    assert states.pop("config_0009") == "failed" and set(states.values()) <= {"success", "pruned"} and len(states) == 2
    assert first.where("status = 'failed'").first()["error_stage"] == "Input Validation"
    before = spark.read.parquet(f"{out}/results").count()
    again = runner.evaluate_models(spark, grid, modelling_rows(spark), "Response", out, **options)
    assert again.count() == 5 and spark.read.parquet(f"{out}/results").count() == before + 2  # only what was missing
    best = runner.summary(again).first()
    assert best["ccc"] > 0.9 and best["best_params"]
    problem = tuning.collect_problem(modelling_rows(spark), "Response", v=3)
    finalized, long = runner.finalize_top(spark, again, problem, 2, bayes_iter=1)
    assert finalized.count() == 2 and {r["kind"] for r in long.select("kind").distinct().collect()} == {"cv", "test"}
    with pytest.raises(ValueError):
        tuning.collect_problem(modelling_rows(spark), "Response", limit=10)


def two_models(spark):
    rows = [(str(i), float(i), m, i + d) for i in range(1, 21) for m, d in (("a", 0.5 * (-1) ** i), ("b", 1.0 * (-1) ** i))]
    return spark.createDataFrame(rows, "row_id string, truth double, model string, pred double")


def test_weighted_average_by_hand(spark):
    rmse = spark.createDataFrame([("a", 0.5), ("b", 1.0)], "model string, rmse double")
    weights = ensemble.inverse_rmse_weights(two_models(spark), rmse)
    assert {r["model"]: r["weight"] for r in weights.collect()} == pytest.approx({"a": 2 / 3, "b": 1 / 3})
    test = spark.createDataFrame([("r", 10.0, "a", 11.0), ("r", 10.0, "b", 9.0)], "row_id string, truth double, model string, pred double")
    assert ensemble.weighted_sum(test, weights).first()["pred"] - 10 == pytest.approx(1 / 3)


def test_stacks(spark):
    rows = spark.createDataFrame([(1.0, 10.0, 10.25), (6.0, 15.0, 5.25)], "a double, b double, c double").limit(1)
    assert ensemble.apply_stack(rows, {"a": 0.5, "b": 0.3, "c": 0.2}).first()["pred"] == pytest.approx(5.55)
    with pytest.raises(ValueError):
        ensemble.apply_stack(rows, {"z": 1.0})
    for method in ensemble.METHODS:
        built = ensemble.build_ensemble(two_models(spark), two_models(spark), method)
        assert built["metrics"].first()["rmse"] < 1.0 if method != "xgb_meta" else built["metrics"].first()["rmse"] < 4
        assert set(built["weights"]) <= {"a", "b"} and built["individual"].count() == 2
    with pytest.raises(ValueError):
        ensemble.build_ensemble(two_models(spark).where("model = 'a'"), two_models(spark))


def test_guarded_calls(tmp_path):
    good = runner.safely(lambda: 3)
    bad = runner.safely(lambda: 1 / 0, 7, trace_file=str(tmp_path / "t"))
    assert good.result == 3 and bad.result == 7 and "ZeroDivisionError" in bad.trace and (tmp_path / "t").read_text()
    assert runner.result_of(good, "x") == 3
    with pytest.raises(RuntimeError):
        runner.result_of(bad, "x")


def test_clusters():
    rng = np.random.default_rng(8)
    x = np.vstack([rng.standard_normal((30, 2)) * 0.3 + 3, rng.standard_normal((30, 2)) * 0.3 - 3])
    for method in ("kmeans", "ward"):
        labels, centers = covariates.cluster_scores(x, 5, method)
        assert len(centers) == 2 and len(set(labels[:30])) == 1
    assert len(covariates.cluster_scores(x[:4])[1]) == 1
    w = covariates.whitening(x)
    d = x[0] - x.mean(0)
    assert np.linalg.norm(w @ d) == pytest.approx(math.sqrt(d @ np.linalg.inv(np.cov(x, rowvar=False)) @ d))


def test_covariate_names():
    assert covariates.classify(["Clay", "MAT", "phh2o", "n"]) == {"soil": ["clay", "ph", "total_nitrogen"], "climate": ["MAT"]}
    for bad in ("slope", "nothing"):
        with pytest.raises(ValueError):
            covariates.classify([bad])
    with pytest.raises(ValueError):
        covariates.validate_properties(["Clay"])


def test_soil_query_asks_for_every_sample(spark, sf, monkeypatch):
    from bandweave.plans import model_queries

    asked = {}

    def spy(spark, samples, library, properties, **settings):
        asked.update(n=samples.count(), settings=settings)
        return {"predictions": spark.createDataFrame([], "Sample_ID string, clay double, ph double")}

    monkeypatch.setattr(model_queries.covariates, "predict_soil_covariates", spy)
    model_queries.soil_covariates(spark, sf)
    assert asked == {"n": spark.read.parquet(f"{sf}/embeddings.parquet").count(), "settings": {}}


def test_whole_joins_keep_every_row(spark, sf):
    from bandweave.plans import catalog

    keys = [{r[0] for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c).collect()} for t, c in (("embeddings", "vec_id"), ("customer", "c_custkey"))]
    got = {r["key"] for r in catalog.queries()["join_full"](spark, sf).collect()}
    assert got == {5 * k for k in keys[0]} | keys[1]


def test_selection_queries_reject_noise(monkeypatch):
    """The registered queries' settings, on bands of which two count."""
    from bandweave.plans import model_queries

    settings = {}
    monkeypatch.setattr(model_queries, "_selected", lambda spark, sf_dir, kind, **given: settings.update({kind: given}))
    model_queries.boruta_bands(None, None)
    model_queries.cars_bands(None, None)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((80, 24))
    y = 3 * x[:, 10] + 2 * x[:, 11] + 0.1 * rng.standard_normal(80)
    kept = set(features.select_boruta(x, y, np.random.default_rng(0), **settings["boruta"]))
    assert {10, 11} <= kept and len(kept) < 12
    assert settings["cars"] == {}


def test_quantiles_around_a_bracket_are_exact(spark):
    from bandweave.operators import relational as rel

    rng = np.random.default_rng(4)
    groups = {"a": rng.standard_normal(3000), "b": np.round(rng.exponential(1, 2000), 1), "c": np.r_[np.zeros(900), rng.random(100)], "d": rng.random(7), "e": np.array([5.0])}
    rows = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("a", None), ("f", None)], "k string, v double")
    shares = [0.0, 0.25, 0.5, 0.6, 0.975, 1.0]
    for direct in (10, 1500, 100_000):
        got = {r["k"]: [r[f"q{i}"] for i in range(len(shares))] for r in rel.quantiles(rows, "v", shares, ["k"], direct).collect()}
        for k, x in groups.items():
            assert np.allclose(got[k], np.quantile(x, shares), rtol=0, atol=1e-12), (direct, k)
    whole = np.concatenate(list(groups.values()))
    assert np.allclose(list(rel.quantiles(rows, "v", shares, None, 10).first()), np.quantile(whole, shares))


def test_ranks_of_pieces_are_whole(spark):
    from pyspark.sql.window import Window

    from bandweave.operators import relational as rel

    rng = np.random.default_rng(5)
    values = sorted({(k, int(v)) for k in range(3) for v in rng.integers(0, 5000, 700)})
    rows = spark.createDataFrame([(k, float(v), int(w)) for (k, v), w in zip(values, rng.integers(1, 4, len(values)))], "k int, v double, w long")
    for r in rel.running_below(rows, ["k"], "v", "w", 8).toPandas().groupby("k"):
        one = r[1].sort_values("v")
        assert (one["_below"].to_numpy() == one["w"].cumsum().to_numpy() - one["w"].to_numpy()).all()
    rows = spark.range(2000).select("id", F.when(F.col("id") % 50 > 0, F.col("id") % 97).cast("double").alias("v"))
    order = F.struct(F.xxhash64("id", F.lit(1)), "id")
    plain = Window.partitionBy("bin").orderBy(order)
    want = {(r["id"], r["bin"], r["k"]) for r in rel.quartile_bin(rows, "v").withColumn("k", F.row_number().over(plain)).collect()}
    assert {(r["id"], r["bin"], r["rank"]) for r in rel.stratified_rank(rows, "v", order, pieces=16).collect()} == want


def test_projection_keeps_its_digits_far_from_zero(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((500, 6)) @ rng.standard_normal((6, 6)) + 1e7
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>").repartition(20)
    found = features.fit_projection(rows, "x", 1.0, scale=False)
    assert np.allclose(found.variances, np.sort(np.linalg.eigvalsh(np.cov(x, rowvar=False)))[::-1], rtol=1e-6)
    assert np.allclose(found.mean, x.mean(0), rtol=1e-12)


def test_spectral_outliers_equal_their_definition(spark):
    """At the production share of variance, where some components are left out."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((200, 8)) * np.array([9, 7, 5, 3, 1, 0.3, 0.1, 0.05])
    x[0] += 40
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>")
    values, vectors = np.linalg.eigh(np.cov(x, rowvar=False))
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int(np.searchsorted(np.cumsum(values) / values.sum(), 0.99)) + 1
    want = np.sqrt((((x - x.mean(0)) @ vectors[:, :k]) ** 2 / values[:k]).sum(1))
    got = {r["id"]: (r["mahalanobis"], r["spectral_outlier"]) for r in features.spectral_outliers(rows, "x", 0.975, 0.99).collect()}
    assert 1 < k < 8 and np.allclose([got[i][0] for i in range(200)], want)
    assert got[0][1] and sum(o for _, o in got.values()) < 30


def test_steps_of_ones_own_are_tuned_like_others(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((60, 20))
    rows = spark.createDataFrame([(f"s{i}", v.tolist(), float(3 * v[6] + 1)) for i, v in enumerate(x)], "Sample_ID string, spectrum array<double>, Response double")

    def strongest(x, y, rng):
        r = np.abs([np.corrcoef(c, y)[0, 1] for c in x.T])
        return lambda v: v[:, [int(r.argmax())]]

    problem = tuning.collect_problem(rows, "Response", v=3, steps={"strongest": strongest})
    configs = relational.create_configs(spark, ("elastic_net",), feature_selection=("strongest", "unknown"))
    found = {r["feature_selection"]: r for r in tuning.evaluate_configurations(spark, configs, problem, 2, 0, False).collect()}
    assert found["strongest"]["status"] == "success" and found["strongest"]["rmse"] < 0.5
    assert found["unknown"]["status"] == "failed" and found["unknown"]["error_stage"] == "Input Validation"


def test_the_metrics_of_tasks_are_those_of_tables(spark):
    from bandweave.functions import metrics

    rng = np.random.default_rng(11)
    truth = rng.lognormal(2, 0.4, 300)
    guess = truth * rng.normal(1, 0.1, 300)
    truth[:3], guess[5:7] = np.nan, np.nan
    clean = lambda v: None if np.isnan(v) else float(v)
    rows = spark.createDataFrame([(clean(t), clean(g)) for t, g in zip(truth, guess)], "t double, e double")
    table, task = metrics.metrics_wide(rows, "t", "e").first().asDict(), tuning.score(truth, guess)
    assert all(math.isclose(table[m], task[m], rel_tol=1e-9) for m in metrics.METRICS)


def test_the_prune_rule_of_the_search_is_that_of_tables(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((80, 20))
    rows = spark.createDataFrame([(f"s{i}", v.tolist(), float(10 + 3 * v[6] + rng.standard_normal())) for i, v in enumerate(x)], "Sample_ID string, spectrum array<double>, Response double")
    problem = tuning.collect_problem(rows, "Response", v=3)
    configs = relational.create_configs(spark, ("elastic_net", "plsr"), preprocessing=("raw",))  # errors of a third or so of the baseline
    y = problem.y[problem.train]
    for threshold in (0.9, 0.01):
        found = tuning.evaluate_configurations(spark, configs, problem, 2, 0, True, threshold)
        best = [(r["config_id"], r["status"]) for r in found.collect()]
        grid = spark.createDataFrame([(c, float(100 * y.std(ddof=1) / y.mean() * 0.35)) for c, _ in best], "config_id string, rrmse double")
        want = {r["config_id"]: r["pruned"] for r in relational.prune_flags(grid, float(y.mean()), float(y.std(ddof=1)), threshold).collect()}
        assert {c: s == "pruned" for c, s in best} == want


def test_importance_by_level_is_that_of_grown_trees(spark):
    """All columns at each split: gains as grow has them; and trees as tasks give what one process gives."""
    from bandweave.operators import models

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    y = 2 * x[:, 1] + x[:, 4] ** 2 + rng.normal(0, 0.1, 300)
    bins, centred = models.Binner(x).apply(x), y - y.mean()
    for least, depth in ((8, 20), (20, 3)):
        own, want = np.random.default_rng(5), np.zeros(6)
        rows = own.integers(0, 300, 300)
        models.grow(bins[rows], centred[rows], 33, depth, least, 6, own, importance=want)
        assert models.tree_importance(bins, centred, 33, depth, least, 6, np.random.default_rng(5)) == pytest.approx(want)
    one, many = (models.forest_importance(x, y, 12, 3, np.random.default_rng(7), s) for s in (None, spark))
    assert many == pytest.approx(one) and set(np.argsort(one)[-2:]) == {1, 4}


def test_splines_take_the_hinges_that_lower_the_error_most():
    """A step of one pair of hinges against least squares over all of them, also where hinges depend on the basis."""
    rng = np.random.default_rng(0)
    for n in (60, 200):
        x = rng.normal(0, 1, (n, 4))
        for y in (np.abs(x[:, 0] - 1) + rng.normal(0, 0.1, n), 3 * np.maximum(x[:, 1] - 0.2, 0) + rng.normal(0, 0.3, n), x[:, 2] + np.sin(3 * x[:, 0])):
            terms, left = [()], None
            while len(terms) < 9:  # as mars adds them, by brute force
                tried = []
                for term in terms:
                    for j in range(4):
                        for knot in np.unique(np.quantile(x[:, j], np.linspace(0.05, 0.95, 10))) if not term else ():
                            pair = models._basis(x, [*terms, ((j, knot, 1),), ((j, knot, -1),)])
                            w = np.linalg.lstsq(pair, y, rcond=1e-10)[0]
                            tried.append((((y - pair @ w) ** 2).sum(), j, knot))
                error, j, knot = min(tried)
                if left is not None and left - error < 1e-9 * (y @ y):
                    break
                left = error
                terms += [((j, knot, 1),), ((j, knot, -1),)]
            found = models.mars(x, y, 1, 4)  # nine terms before any is dropped
            assert set(found.terms) <= set(terms)
            many = models.mars(x, y, 1, 20)
            assert ((many.predict(x) - y) ** 2).sum() <= 1.5 * left + 1e-9


def test_clusters_and_silhouette_equal_their_definitions():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 0.3, (30, 5)) for m in (0, 2, 4)])
    labels, centers = covariates.kmeans(x, 3, np.random.default_rng(0), starts=5)
    assert (labels == ((x[:, None] - centers) ** 2).sum(2).argmin(1)).all()
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    own = [(d[i, labels == labels[i]].sum() / 29, min(d[i, labels == k].mean() for k in range(3) if k != labels[i])) for i in range(90)]
    assert covariates.silhouette(x, labels) == pytest.approx(np.mean([(b - a) / max(a, b) for a, b in own]))


def test_large_kernels_and_neighbours_are_worked_out_in_parts(monkeypatch):
    """With little memory the SVM and cubist's neighbours give what they give with all of it."""
    from bandweave.operators import models

    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 6))
    y = np.sin(x[:, 0]) + x[:, 1] + rng.normal(0, 0.1, 150)
    settings = {"cost": 2.0, "rbf_sigma": 0.05}
    whole = models.fit("svm_rbf", x, y, settings).predict(x)
    made, rbf = [], models.rbf
    monkeypatch.setattr(models, "WHOLE_KERNEL", 1000)
    monkeypatch.setattr(models, "PART_OF_KERNEL", 1000)
    monkeypatch.setattr(models, "rbf", lambda a, b, sigma: made.append(len(a) * len(b)) or rbf(a, b, sigma))
    assert models.fit("svm_rbf", x, y, settings).predict(x) == pytest.approx(whole, abs=1e-6)
    assert max(made) <= 1000
    places, distances = models.nearest(x[:40], x, 4)
    far = np.abs(x[:40, None] - x).sum(2)
    assert (places == np.argsort(far, 1)[:, :4]).all() and distances == pytest.approx(np.sort(far, 1)[:, :4])


def test_held_out_predictions_are_the_models():
    from bandweave.operators import models

    rng = np.random.default_rng(8)
    x, ask = rng.normal(size=(60, 5)), rng.normal(size=(9, 5))
    for name in ("random_forest", "xgboost", "lightgbm", "cubist"):
        assert models.held_out(name, x, x[:, 0], ask, trees=7) == pytest.approx(models.fit(name, x, x[:, 0], trees=7).predict(ask))


def test_model_search_leaves_the_settings_to_the_operators(monkeypatch):
    """Ten folds, grids of ten, fifteen rounds of search and 500 trees, as the operators have them."""
    from bandweave.plans import model_queries

    given = []
    monkeypatch.setattr(model_queries, "_dataset", lambda spark, sf_dir: "rows")
    monkeypatch.setattr(model_queries, "_configs", lambda spark, models: models)
    monkeypatch.setattr(model_queries.tuning, "collect_problem", lambda *a, **b: given.append((a, b)) or "problem")

    class Stop(Exception):
        pass

    def spy(*a, **b):
        given.append((a, b))
        raise Stop

    monkeypatch.setattr(model_queries.tuning, "evaluate_configurations", spy)
    with pytest.raises(Stop):
        model_queries.model_search(None, None)
    from bandweave.schema import MODELS

    assert given == [(("rows", "Response"), {"preprocessing": ("snv_deriv1",)}), ((None, MODELS, "problem"), {})]


def test_soil_covariates_take_any_number_of_samples(spark):
    """No limit on samples; clusters and local fits by tasks are what one process finds."""
    import inspect

    from bandweave.operators import models

    assert "limit" not in inspect.signature(covariates.predict_soil_covariates).parameters
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(m, 0.3, (40, 4)) for m in (0, 3, 5)])
    for method in ("kmeans", "ward"):
        one, many = covariates.cluster_scores(x, 5, method), covariates.cluster_scores(x, 5, method, spark=spark)
        assert (one[0] == many[0]).all() and many[1] == pytest.approx(one[1])
    rows, ask = np.arange(90), np.arange(90, 120)
    y = x[rows, 0] + 0.1 * rng.normal(size=90)
    got = covariates.fit_local_cubists(spark, x, [(rows, y, ask), (rows[:0], y[:0], ask)], x, 3, 2, 4, piece=7)
    part = covariates.local_folds(y, 4, 307)

    def error(params):
        total = sum(((models.fit("cubist", x[rows[part != k]], y[part != k], params).predict(x[rows[part == k]]) - y[part == k]) ** 2).sum() for k in range(4))
        return math.sqrt(total / len(y))

    space = covariates.CUBIST_SPACE
    params, _, _ = tuning.bayes_search(space, error, [(p, error(p)) for p in tuning.candidates(space, 3)], 2, 10)
    assert got[0] == pytest.approx(models.fit("cubist", x[rows], y, params).predict(x[ask])) and got[1] is None


def test_boruta_ends_as_soon_as_no_run_can_change_it(monkeypatch):
    """The columns of all 25 runs from fewer: hits so far keep a column, whatever comes."""
    from bandweave.operators import models

    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 6))
    done = []

    def importance(base, y, trees, mtry, rng, spark):
        done.append(base.shape[1])
        half = base.shape[1] // 2
        return np.r_[2.0, 2.0, np.zeros(half - 2), np.ones(half)]  # the first two beat the shadows in each run

    monkeypatch.setattr(models, "forest_importance", importance)
    kept = features.select_boruta(x, x[:, 0], np.random.default_rng(0))
    assert kept.tolist() == [0, 1] and len(done) == 10  # no hit in ten runs rejects one of six columns
    assert features._binomial_tail(10, 0) < 0.01 / 6 <= min(features._binomial_tail(9, 0), features._binomial_tail(25, 10))


def test_trees_without_a_limit_do_not_hold_the_sums_of_waiting_nodes():
    """Sums by difference give the trees that sums of rows give, and are held only where few nodes wait."""
    import tracemalloc

    from bandweave.operators import models

    rng = np.random.default_rng(9)
    bins, y = rng.integers(0, 33, (3000, 20)).astype(np.int16), rng.normal(size=3000)
    limited, free = (models.grow(bins, y, 33, 20, 5, 20, rng, limit=limit) for limit in (5000, None))
    assert sorted(limited.predict(bins)) == pytest.approx(sorted(free.predict(bins)))
    tracemalloc.start()
    models.grow(bins, y, 33, 20, 1, 20, rng)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6e6  # the waiting nodes' sums alone would be over that
