"""Ensembles over long predictions (row_id, truth, model, pred): weighted average, stacking, boosted meta-learner."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandweave.functions import metrics

METHODS = ("stacks", "weighted_average", "xgb_meta")


def inverse_rmse_weights(predictions: DataFrame, rmse: DataFrame | None = None) -> DataFrame:
    """(model, rmse, weight): weights in proportion to 1 / RMSE, of the predictions or as given."""
    rmse = predictions.groupBy("model").agg(metrics.rmse("truth", "pred").alias("rmse")) if rmse is None else rmse
    usable = rmse.where("rmse > 0")
    total = usable.agg(F.sum(1 / F.col("rmse")).alias("_total"))
    return usable.crossJoin(F.broadcast(total)).select("model", "rmse", (1 / F.col("rmse") / F.col("_total")).alias("weight"))


def weighted_sum(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    """(row_id, truth, pred): models without predictions drop out, and weights are not scaled up for them."""
    few = weights.select("model", "weight")
    joined = predictions.join(F.broadcast(few) if few.limit(10_001).count() <= 10_000 else few, "model")
    return joined.groupBy("row_id", "truth").agg(F.sum(F.col("pred") * F.col("weight")).alias("pred"))


def apply_stack(wide: DataFrame, coefficients: dict[str, float], into: str = "pred") -> DataFrame:
    """Dot product of the columns named in coefficients, without intercept; a missing column is an error."""
    missing = sorted(set(coefficients) - set(wide.columns))
    if missing:
        raise ValueError(f"no predictions of {', '.join(missing)}")
    total = F.lit(0.0)
    for name, weight in coefficients.items():
        total = total + F.col(name) * F.lit(float(weight))
    return wide.withColumn(into, total)


def improvement(predictions: DataFrame, blended: DataFrame) -> DataFrame:
    """Percent by which the ensemble's RMSE is below the best single model's, to two places."""
    best = predictions.groupBy("model").agg(metrics.rmse("truth", "pred").alias("r")).agg(F.min("r").alias("best"))
    own = blended.agg(metrics.rmse("truth", "pred").alias("own"))
    return best.crossJoin(own).select(F.round(100 * (F.col("best") - F.col("own")) / F.nullif(F.col("best"), F.lit(0.0)), 2).alias("improvement"))


def nonnegative_lasso(x: np.ndarray, y: np.ndarray, penalty: float, mixture: float = 1.0, rounds: int = 2000) -> np.ndarray:
    """Non-negative elastic net by coordinate descent on (y - x w)^2 / 2n, columns scaled, without intercept in the result."""
    n, scale = len(y), x.std(0)
    scale = np.where(scale > 1e-12, scale, np.inf)
    z, r = (x - x.mean(0)) / scale, y - y.mean()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(w)):
            r = r + z[:, j] * w[j]
            w[j] = max(0.0, (z[:, j] @ r / n - penalty * mixture) / (1 + penalty * (1 - mixture)))
            r = r - z[:, j] * w[j]
        if np.abs(w - before).max() < 1e-9:
            break
    return w / scale


def pivoted(predictions: DataFrame, models: list[str]) -> DataFrame:
    return predictions.groupBy("row_id", "truth").pivot("model", models).agg(F.first("pred"))


def stack_coefficients(cv: DataFrame, models: list[str], penalty: float | None = 0.01, folds: int = 5, limit: int = 2_000_000) -> dict[str, float]:
    """Coefficients of a non-negative penalised regression on cross-validated predictions. penalty None: of a grid of 20
    penalties the one of lowest error. The table of predictions must have at most limit values."""
    wide = pivoted(cv, models).dropna()
    if wide.count() * (len(models) + 1) > limit:
        raise ValueError("too many predictions for one fit; lower them or use weighted_average")
    pdf = wide.toPandas()
    pdf = pdf.loc[pdf["row_id"].astype(str).sort_values().index]
    x, y = pdf[models].to_numpy(float), pdf["truth"].to_numpy(float)
    unit = y.std() or 1.0
    if penalty is None:
        part, errors = np.arange(len(y)) % folds, {}
        for p in np.logspace(-4, 0, 20):
            error = 0.0
            for k in range(folds):
                w = nonnegative_lasso(x[part != k], y[part != k], p * unit)
                guess = y[part != k].mean() + (x[part == k] - x[part != k].mean(0)) @ w
                error += ((guess - y[part == k]) ** 2).sum()
            errors[p] = error
        penalty = min(errors, key=errors.get)
    w = nonnegative_lasso(x, y, penalty * unit)
    return {m: float(v) for m, v in zip(models, w, strict=True) if v > 0}


def boosted_meta(cv: DataFrame, test: DataFrame, models: list[str], rounds: int = 50, seed: int = 123) -> tuple[DataFrame, dict[str, float]]:
    """Predictions of boosted trees (depth 2, rate .05, sample .8) on the models' predictions, and gain shares as weights."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    assembler = VectorAssembler(inputCols=models, outputCol="_features")
    trees = GBTRegressor(featuresCol="_features", labelCol="truth", predictionCol="pred", maxDepth=2, stepSize=0.05, subsamplingRate=0.8, maxIter=rounds, seed=seed)
    model = trees.fit(assembler.transform(pivoted(cv, models).dropna()))
    found = model.transform(assembler.transform(pivoted(test, models).dropna())).select("row_id", "truth", "pred")
    return found, dict(zip(models, model.featureImportances.toArray().tolist(), strict=True))


def build_ensemble(cv: DataFrame, test: DataFrame, method: str = "stacks", optimize: bool = False, blend_metric: str = "rmse") -> dict:
    """predictions, metrics, weights, individual metrics and improvement of an ensemble of at least two models.

    cv and test: (row_id, truth, model, pred) on the response's own scale, cv from cross-validation.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    models = [r["model"] for r in cv.select("model").distinct().orderBy("model").limit(1001).collect()]
    if not 2 <= len(models) <= 1000:
        raise ValueError("an ensemble needs at least two models")
    if method == "weighted_average":
        scores = cv.groupBy("model").agg(metrics.metric(blend_metric, "truth", "pred").alias("v"))
        better = metrics.LARGER_IS_BETTER[blend_metric]
        weights = inverse_rmse_weights(cv, scores.select("model", (1 / F.nullif(F.col("v"), F.lit(0.0)) if better else F.col("v")).alias("rmse")))
        predictions = weighted_sum(test, weights)
        kept = {r["model"]: r["weight"] for r in weights.collect()}
    elif method == "stacks":
        kept = stack_coefficients(cv, models, None if optimize else 0.01)
        predictions = apply_stack(pivoted(test, models), kept)
        shift = cv.groupBy("row_id", "truth").pivot("model", models).agg(F.first("pred")).dropna()
        offset = apply_stack(shift, kept).agg(F.avg(F.col("truth") - F.col("pred"))).first()[0] if kept else shift.agg(F.avg("truth")).first()[0]
        predictions = predictions.select("row_id", "truth", (F.col("pred") + F.lit(float(offset or 0.0))).alias("pred"))
    else:
        predictions, kept = boosted_meta(cv, test, models, 100 if optimize else 50)
    return {
        "method": method,
        "predictions": predictions,
        "metrics": metrics.metrics_wide(predictions, "truth", "pred"),
        "weights": kept,
        "individual": metrics.metrics_wide(test, "truth", "pred", ["model"]),
        "improvement": improvement(test, predictions),
    }
