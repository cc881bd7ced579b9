"""Quality by Bradley-Terry pairwise ranking.

A document's score is linear in its features. Each training pair has a preferred and another document; the
probability that the first is preferred is the logistic function of their score difference, and the loss is its
negative logarithm. The rejected share of the labelled rows gives the quantile of the scores that is the threshold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandweave.llm.common import bounded_batches
from bandweave.llm.labelled import held_out, with_labels

#: Bound of the training sample: so many documents of each label; and the pairs drawn from it.
PER_CLASS, PAIRS = 3000, 60_000
EPOCHS, RATE, DECAY = 300, 0.5, 1e-4
#: A document is predicted to be good from this score, at which the quantile threshold is placed.
CUT = 0.3
NEAR = 0.001
#: Identifiers of labelled rows up to which they are broadcast.
BROADCAST_IDS = 2_000_000
_PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]


def features(text: str | None) -> np.ndarray:
    """Shares of bytes, tokens and lines, and how much of the text repeats. Null counts as empty."""
    data = (text or "").encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / max(1, len(data))
    words = (text or "").split()
    n = max(1, len(words))
    lines = [x for x in (text or "").split("\n") if x.strip()]
    again = sum(map(str.__eq__, words[1:], words[:-1]))
    plain = [
        counts[65:91].sum(),
        counts[48:58].sum(),
        counts[128:].sum(),
        len(set(words)) / n,
        again / n,
        len(set(lines)) / max(1, len(lines)),
        min(20.0, len(data) / n) / 20,
        np.log1p(len(words)) / 10,
        sum(map(str.isupper, words)) / n,
        sum(map(str.isalpha, words)) / n,
        *counts[_PUNCTUATION],
    ]
    values = np.array(plain)
    return np.concatenate([values, np.sqrt(values), values > 0.02])


class Ranking:
    """score = weights . (features - mean) / sd; quality maps it to 0..1 with the threshold at CUT."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, weights: np.ndarray, threshold: float = 0.0, scale: float = 1.0):
        self.mean, self.sd, self.weights, self.threshold, self.scale = mean, sd, weights, threshold, scale

    def strength(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.mean) / self.sd) @ self.weights

    def quality(self, rows: np.ndarray) -> np.ndarray:
        z = (self.strength(rows) - self.threshold) / self.scale + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: np.ndarray, labels: np.ndarray, rejected_share: float | None = None, pairs: int = PAIRS, seed: int = 5) -> Ranking:
    """rejected_share: of label 0 among all labelled rows (of the sample, if not given). One class only: all are good."""
    labels = np.asarray(labels)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    width = rows.shape[1]
    if not len(good) or not len(bad):
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), -1.0)
    mean, sd = rows.mean(0), rows.std(0)
    sd = np.where(sd > 1e-9, sd, np.inf)  # constant features do not count
    x, rng = (rows - mean) / sd, np.random.default_rng(seed)
    better, worse = rng.choice(good, pairs), rng.choice(bad, pairs)
    weights, squares = np.zeros(width), np.full(width, 1e-6)
    for _ in range(EPOCHS):
        score = x @ weights
        wrong = 1 / (1 + np.exp(np.clip(score[better] - score[worse], -30, 30)))
        pull = np.bincount(better, wrong, len(x)) - np.bincount(worse, wrong, len(x))
        grad = -(pull @ x) / pairs + DECAY * weights
        squares += grad * grad
        weights -= RATE * grad / np.sqrt(squares)
    found = Ranking(mean, sd, weights)
    scores = found.strength(rows)
    share = len(bad) / len(labels) if rejected_share is None else rejected_share
    # the sample may hold the labels in other shares than the rows: weigh it back before taking the quantile
    weight = np.where(labels == 0, share / len(bad), (1 - share) / len(good))
    order = np.argsort(scores)
    at = int(np.searchsorted(np.cumsum(weight[order]), share - 1e-9))
    near = scores[order]
    above = near[min(at + 1, len(near) - 1)]
    found.threshold = float((near[at] + above) / 2)
    found.scale = float(max(1e-6, np.std(scores) / 4))
    return found


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Ranking:
    """Fits the weights on the bounded sample, whose features are made by the executors. The threshold is the quantile of the
    scores of all labelled rows that are not held out, at the share of rejected ones (midway over NEAR on either side)."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def described(texts):
        import pandas as pd

        return pd.Series([features(t) for t in texts])

    rows = with_labels(docs, labels, label_col, per_class, id_col, text_col)
    got = rows.select(id_col, "label", described(F.col("text")).alias("x")).toPandas().sort_values(id_col)
    if got.empty:
        return fit(np.zeros((0, len(features("")))), np.zeros(0))
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(id_col).agg(F.max(label_col).alias("label"))
    share = usable.agg(F.avg((F.col("label") == 0).cast("double"))).first()[0]
    model = fit(np.stack(got["x"].to_numpy()), got["label"].to_numpy(), share)
    if 0 < share < 1:
        few = usable.select(id_col)
        few = F.broadcast(few) if few.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else few
        scores = docs.select(id_col, text_col).join(few, id_col, "left_semi").select(_strength(docs.sparkSession, model, text_col).alias("s"))
        near = [min(max(share + d, 0.0), 1.0) for d in (-NEAR, NEAR)]
        low, high = scores.agg(F.percentile_approx("s", near, 10_000)).first()[0] or (model.threshold, model.threshold)
        model.threshold = float((low + high) / 2)
    return model


def _strength(spark, model: Ranking, text_col: str):
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def strength(texts):
        import pandas as pd

        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(shared.value.strength(np.stack([features(t) for t in texts])))

    return strength(F.col(text_col).cast("string"))


def score_documents(docs: DataFrame, model: Ranking, text_col: str = "text", score: str = "quality_score", predicted: str = "quality_predicted") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from CUT); columns of these names are replaced, others stay.

    Null counts as empty; whole texts are read, whatever their length. Repeated rows stay, an empty table stays empty.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def judge(texts):
        import pandas as pd

        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(shared.value.quality(np.stack([features(t) for t in texts])))

    rows = docs.withColumn(score, judge(F.col(text_col).cast("string")))
    return rows.withColumn(predicted, (F.col(score) >= CUT).cast("int"))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))
