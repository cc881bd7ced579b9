"""Runs of a model search: resume, error records, summaries, the best refitted. And how the outcome of a step is kept."""

from __future__ import annotations

import logging
import traceback
import warnings
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandweave import schema
from bandweave.operators import models, tuning
from bandweave.operators.relational import top_n, with_workflow_id
from bandweave.sources import sinks

log = logging.getLogger("bandweave")


@dataclass
class Outcome:
    """What a guarded call gave: its result or its error, and what it said on the way."""

    result: Any = None
    error: BaseException | None = None
    trace: str | None = None
    warnings: list[str] = field(default_factory=list)

    @property
    def n_warnings(self) -> int:
        return len(self.warnings)


def safely(call, default: Any = None, message: str | None = None, capture_trace: bool = True, trace_file: str | None = None) -> Outcome:
    """Runs call(); an error gives the default and is kept, logged and, if wanted, appended to a file."""
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        try:
            out = Outcome(call())
        except Exception as error:
            out = Outcome(default, error, traceback.format_exc() if capture_trace else None)
            log.warning("%s: %s", message or "failed", error)
            if trace_file and out.trace:
                with open(trace_file, "a", encoding="utf-8") as file:
                    file.write(f"{datetime.now(timezone.utc).isoformat()} {message or ''}\n{out.trace}\n")
    out.warnings = [str(w.message) for w in caught]
    return out


def result_of(outcome: Outcome, title: str, hints: tuple[str, ...] = (), abort_on_none: bool = True) -> Any:
    """The result; an error, or none where one is needed, is raised under a title with hints."""
    if outcome.error is not None or (abort_on_none and outcome.result is None):
        raise RuntimeError("\n".join([f"{title}: {outcome.error or 'no result'}", *hints])) from outcome.error
    return outcome.result


def evaluate_models(spark: SparkSession, configs: DataFrame, data: DataFrame, response: str, output_dir: str, key: str = "Sample_ID", covariates: tuple[str, ...] = (), resume: bool = True, batch: int = 100, cv_folds: int = schema.DEFAULT_CV_FOLDS, train_share: float = 0.8, seed: int = 307, **search) -> DataFrame:
    """Evaluates every configuration that has no success or pruned row in output_dir yet (failed ones are tried again).

    Results are appended in batches of configurations, so that a stopped run goes on where it was. output_dir gets
    results (a table), errors (JSON), summary (CSV) and run_metadata (JSON). Returns the last row of each configuration.
    """
    began, store = datetime.now(timezone.utc), f"{output_dir}/results"
    done = _stored(spark, store) if resume else None
    waiting = configs if done is None else configs.join(done.where("status IN ('success', 'pruned')").select("config_id"), "config_id", "left_anti")
    ids = [r[0] for r in waiting.select("config_id").orderBy("config_id").collect()]  # the grid, made by the driver
    kinds = tuple(r[0] for r in configs.select("preprocessing").distinct().orderBy("preprocessing").collect() if r[0] in schema.PREPROCESSING)
    mode = "append" if resume else "overwrite"
    if ids:
        problem = tuning.collect_problem(data, response, key, preprocessing=kinds, covariates=covariates, train_share=train_share, v=cv_folds, seed=seed)
        for start in range(0, len(ids), batch):
            part = waiting.where(F.col("config_id").isin(ids[start : start + batch]))
            found = tuning.evaluate_configurations(spark, part, problem, seed=seed, **search)
            sinks.write_table(found.withColumn("recorded", F.current_timestamp()), store, mode)
            mode = "append"
    results = latest(_stored(spark, store))
    sinks.write_errors(results, f"{output_dir}/errors")
    sinks.write_csv(results, f"{output_dir}/summary")
    counts = {r["status"]: r["n"] for r in status_counts(results).collect()}
    minutes = (datetime.now(timezone.utc) - began).total_seconds() / 60
    sinks.write_metadata(spark, {"n_models": sum(counts.values()), "n_completed": counts.get("success", 0), "n_pruned": counts.get("pruned", 0), "n_errors": counts.get("failed", 0), "total_time_mins": minutes, "parameters": search, "timestamp": began}, f"{output_dir}/run_metadata")
    return results


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def status_counts(results: DataFrame) -> DataFrame:
    """(status, n): success, pruned and failed configurations."""
    return results.groupBy("status").agg(F.count("*").alias("n"))


def latest(results: DataFrame) -> DataFrame:
    """The last recorded row of each configuration."""
    names = [c for c in results.columns if c not in ("config_id", "recorded")]
    return results.groupBy("config_id").agg(F.max_by(F.struct(*names), "recorded").alias("r")).select("config_id", "r.*")


def summary(results: DataFrame, metric: str = "rrmse", n: int = 10) -> DataFrame:
    """The n best successful configurations."""
    return top_n(results.where("status = 'success'"), metric, n)


def finalize_top(spark: SparkSession, results: DataFrame, problem: tuning.Problem, n_best: int = 10, metric: str = "rrmse", bayes_iter: int = 15, trees: int = 500, seed: int = 307) -> tuple[DataFrame, DataFrame]:
    """Refits the n best configurations: a warm grid around their parameters, a short Bayesian search, then predictions.

    Returns (finalized: config and final parameters, predictions: long, cv and test, on the response's own scale).
    """
    usable = results.where("status = 'success' AND best_params IS NOT NULL")
    best = tuning.by_metric([r.asDict() for r in top_n(usable, metric, n_best).collect()], metric, n_best)
    if not best:
        raise ValueError("no successful configuration")
    for b in best:
        b["covariates"] = (b["covariates"] or "").split("-") if b["covariates"] else []
    shared = spark.sparkContext.broadcast(problem)

    def tune(batches):
        import pandas as pd

        own = shared.value
        for pdf in batches:
            for i in pdf["config"]:
                config = best[i]
                designs = tuning.fold_designs(own, config)
                space = models.param_space(config["model"], min(d[0].shape[1] for d in designs))
                value = lambda p, c=config, d=designs: tuning.cross_validate(d, c, p, trees)["rrmse"]
                start = {k: float(v) for k, v in config["best_params"].items() if k in space}
                warm = [(p, value(p)) for p in [start, *tuning.neighbourhood(start, space, 8, seed)]]
                params, error, rounds = tuning.bayes_search(space, value, warm, bayes_iter, 5, seed)
                yield pd.DataFrame([(config["config_id"], config["workflow_id"], config["model"], config["transformation"], params, error, rounds)], columns=["config_id", "workflow_id", "model", "transformation", "final_params", "cv_rrmse", "bayes_rounds"])

    frame = spark.createDataFrame([(i,) for i in range(len(best))], "config int").repartitionByRange(len(best), "config")
    rows = frame.mapInPandas(tune, "config_id string, workflow_id string, model string, transformation string, final_params map<string,double>, cv_rrmse double, bayes_rounds int").collect()
    by_id = {r["config_id"]: r["final_params"] for r in rows}
    finalized = spark.createDataFrame(rows, "config_id string, workflow_id string, model string, transformation string, final_params map<string,double>, cv_rrmse double, bayes_rounds int")
    return finalized, tuning.predictions_of(spark, best, [by_id[b["config_id"]] for b in best], problem, trees, seed)


def parallel_settings(executor_cores: int = 4, buffer: int = schema.CORE_BUFFER) -> dict[str, str]:
    """Session settings for a model search: single-threaded BLAS in each Python worker, and tasks that are not merged."""
    threads = {f"spark.executorEnv.{n}": "1" for n in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS", "VECLIB_MAXIMUM_THREADS")}
    return {**threads, "spark.executor.cores": str(max(1, executor_cores)), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.task.cpus": "1"}
