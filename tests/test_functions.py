import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandweave.functions import climate, metrics, spectral, text
from bandweave.operators import kernels, tuning


def pairs(spark, truth, guess):
    return spark.createDataFrame(list(zip(truth, guess, strict=True)), "t double, e double")


def test_metrics_by_hand(spark):
    t, e = [10.0, 20.0, 30.0, 40.0, 50.0], [12.0, 18.0, 32.0, 38.0, 52.0]
    row = metrics.metrics_wide(pairs(spark, t, e), "t", "e").first()
    assert row["rmse"] == pytest.approx(2) and row["rpd"] == pytest.approx(np.std(t, ddof=1) / 2) and row["mae"] == pytest.approx(2)
    assert row["ccc"] == pytest.approx(2 * np.cov(t, e)[0, 1] / (np.var(t, ddof=1) + np.var(e, ddof=1) + (np.mean(t) - np.mean(e)) ** 2))
    assert {k: row[k] for k in metrics.METRICS} == pytest.approx(tuning.score(np.array(t), np.array(e)))


@pytest.mark.parametrize(
    "truth, guess, name, want",
    [
        ([1.0, 2.0], [1.0, 2.0], "rpd", math.inf),
        ([3.0, 3.0], [1.0, 2.0], "rpd", 0.0),
        ([3.0], [1.0], "rpd", None),
        ([3.0], [1.0], "ccc", None),
        ([3.0, 3.0], [1.0, 2.0], "ccc", None),
        ([3.0, 3.0], [1.0, 2.0], "rsq", None),
        ([-1.0, 1.0], [0.0, 0.0], "rrmse", math.inf),
        ([100.0, None, 140.0, 160.0, float("nan")], [110.0, 1.0, None, 150.0, 2.0], "rrmse", 100 * 10 / (400 / 3)),
    ],
)
def test_metric_edges(spark, truth, guess, name, want):
    got = pairs(spark, truth, guess).agg(metrics.metric(name, "t", "e")).first()[0]
    assert got == (want if want is None else pytest.approx(want))


def test_long_metrics_need_two_pairs(spark):
    assert metrics.metrics_long(pairs(spark, [1.0], [2.0]), "t", "e").count() == 0
    assert metrics.metrics_long(pairs(spark, [1.0, 2.0], [2.0, 2.0]), "t", "e").count() == len(metrics.METRICS)
    with pytest.raises(ValueError):
        metrics.metric("nope", "t", "e")


def one(spark, values, column):
    return spark.createDataFrame([(values,)], "x array<double>").select(column.alias("y")).first()["y"]


def test_spectral_transforms(spark):
    x = [float(i) for i in range(1, 16)]
    assert one(spark, x, spectral.process("x", "raw", 5)) == x[2:13]
    assert len(one(spark, x, spectral.process("x", "sg", 5))) == 11
    assert one(spark, x, spectral.process("x", "deriv1", 5)) == pytest.approx([1.0] * 11)
    y = np.array(x) ** 2
    assert one(spark, y.tolist(), spectral.process("x", "deriv2", 9)) == pytest.approx([1.0] * 7)
    assert one(spark, y.tolist(), spectral.process("x", "deriv2", 9, True)) == pytest.approx([2.0] * 7)
    z = (y - y.mean()) / y.std(ddof=1)
    assert one(spark, y.tolist(), spectral.process("x", "snv", 9)) == pytest.approx(z[4:-4].tolist())
    assert one(spark, [2.0] * 12, spectral.process("x", "snv", 9)) is None
    assert one(spark, [1.0, 2.0], spectral.process("x", "sg", 9)) == []
    assert one(spark, None, spectral.process("x", "deriv1", 9)) is None
    with pytest.raises(ValueError):
        spectral.process("x", "other")


def test_second_derivative_weights():
    assert np.allclose(np.array(spectral.savgol_kernel(9, 3, 2)) * 462, [14, 3.5, -4, -8.5, -10, -8.5, -4, 3.5, 14])


def test_baselines_and_resampling(spark):
    old = np.linspace(600, 4000, 400)[::-1]
    cubic = 1e-3 * old + 2
    assert np.allclose(kernels.spline_weights(old, np.array([700.0, 1234.5, 3999.0])) @ cubic, 1e-3 * np.array([700, 1234.5, 3999]) + 2)
    smooth = np.sin(old / 300)
    new = np.arange(700, 3900, 2.0)
    assert np.abs(kernels.spline_weights(old, new) @ smooth - np.sin(new / 300)).max() < 1e-4
    peak = 0.5 + old / 4000 + np.exp(-(((old - 2000) / 50) ** 2))
    flat = kernels.rubberband(peak[None], old)[0]
    assert flat.min() > -1e-9 and abs(flat[np.abs(old - 2000).argmin()] - 1) < 0.05
    assert np.abs(kernels.detrend((old**2)[None] / 1e6, old)).max() < 1e-8
    from bandweave.sources.readers import axis, with_metadata

    rows = with_metadata(spark.createDataFrame([("a", smooth.tolist()), ("b", None)], "Sample_ID string, spectrum array<double>"), wavenumbers=old.tolist(), spectra_type="MIR")
    out = kernels.preprocess_spectra(rows, 2)
    assert len(axis(out)) == 1701 and axis(out)[0] == 600
    got = {r["Sample_ID"]: r["spectrum"] for r in out.collect()}
    assert got["b"] is None and len(got["a"]) == 1701
    with pytest.raises(ValueError):
        kernels.preprocess_spectra(rows, 2, "other")


def test_file_names(spark):
    rows = spark.createDataFrame([("FFAR_S094-A_GroundBulk_S1.0",), ("short",), ("P_S1_F_S2_more.csv",)], "f string")
    parts = text.parse_file_name("f", "project_sampleid_fraction_scanid")
    got = [tuple(r) for r in rows.select(*[parts[c].alias(c) for c in ("Project", "Sample_ID", "Fraction", "Scan")]).collect()]
    assert got == [("FFAR", "S094-A", "GroundBulk", "S1"), (None, "UNKNOWN", "GroundBulk", None), ("P", "S1", "F", "S2")]


def test_workflow_ids_and_names(spark):
    row = spark.range(1).select(
        text.workflow_id(F.lit("random_forest"), F.lit("sqrt"), F.lit("SNV"), F.lit("boruta"), F.array(F.lit("clay"), F.lit(""), F.lit("ph")), F.lit(True)).alias("id"),
        text.workflow_id(F.lit("m"), F.lit("box"), F.lit("x"), F.lit("y"), F.lit(None).cast("array<string>"), F.lit(None).cast("boolean")).alias("other"),
    ).first()
    assert row["id"] == "random_forest_Sqrt_SNV_Boruta_clay+ph_Interact" and row["other"] == "m_box_X_Y_NoCovs_NoInteract"
    got = spark.createDataFrame([(row["id"],), ("cubist_NA_NA_NA_NA",), ("odd",)], "w string").select(text.parse_workflow_id("w").alias("p")).collect()
    assert tuple(got[0]["p"]) == ("Random Forest", "Square Root", "Standard Normal Variate", "Boruta Algorithm", "Clay Content + pH")
    assert tuple(got[1]["p"]) == ("Cubist", "None", "Raw Spectra", "No Selection", "None")
    assert got[2]["p"]["model"] == "unknown"
    assert spark.range(1).select(text.readable("model", F.lit(None).cast("string"))).first()[0] == "Unknown"


def test_back_transformation(spark):
    rows = spark.createDataFrame([(-1.0,), (0.0,), (2.0,), (None,)], "p double")
    got = lambda k, c=False: [r[0] for r in rows.select(text.back_transform("p", F.lit(k), c)).collect()]
    assert got("sqrt", True) == [0.0, 0.0, 4.0, None] and got("sqrt") == [1.0, 0.0, 4.0, None]
    assert got("none") == [-1.0, 0.0, 2.0, None] and got("log")[2] == pytest.approx(math.exp(2))
    flags = spark.createDataFrame([("log",), ("NoTrans",), (None,), ("",)], "k string").select(text.needs_back_transformation("k")).collect()
    assert [r[0] for r in flags] == [True, False, False, False]


def test_climate_scalars(spark):
    row = spark.range(1).select(
        climate.grid_id(F.lit(-105.0), F.lit(40.02)).alias("g"), climate.pet(F.lit(40.0), F.lit(180), F.lit(10.0), F.lit(30.0)).alias("e"),
        climate.pet(F.lit(89.0), F.lit(173), F.lit(0.0), F.lit(9.0)).alias("polar"), climate.degree_days(F.lit(5.0)).alias("d"), climate.day_of(F.lit(2004), F.lit(60)).cast("string").alias("day"),
    ).first()
    assert row["g"].startswith("-105.0_40.0") and 1 < row["e"] < 40 and row["polar"] is None and row["d"] == 0 and row["day"] == "2004-02-29"
