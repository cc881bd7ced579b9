"""Toxicity by multiple-instance learning: documents are bags of sentences, and only documents have labels.

A sentence's probability is a logistic function of its words; a document's is the noisy-or of its sentences,
1 - prod(1 - p). Training follows the gradient of the document's log-loss through the noisy-or, so that it finds by
itself which sentences of a toxic document offend. Words count whole and by their first characters, so that inflected
forms share weight.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandweave.llm.common import bounded_batches
from bandweave.llm.labelled import held_out, with_labels

#: Bounds of the training sample: so many documents of each label, and characters of their texts.
PER_CLASS, MOST_CHARS = 2000, 16 << 20
#: A feature is learnt if it is in at least this many documents of the sample.
LEAST_DOCS = 4
PREFIXES = (4, 5)
BUCKETS = 1 << 22
EPOCHS, RATE, DECAY, START = 120, 0.5, 1e-4, -9.0
#: Weights shrink towards zero by this much at each step, and the bias, which all sentences share, moves slower than they.
SHRINK, BIAS_RATE = 2e-4, 0.1
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")
_KNOWN = 200_000


def features(token: str) -> list[int]:
    """Buckets of a token's words: each word whole and by its prefixes."""
    found = []
    for word in _WORD.findall(token):
        data = word.encode()
        found.append(zlib.crc32(data) % BUCKETS)
        found += [zlib.crc32(word[:n].encode(), n) % BUCKETS for n in PREFIXES if len(word) >= n]
    return found


def sentences(text: str | None) -> list[tuple[int, int, set[str]]]:
    """(start, end, distinct lower-case tokens) of the stretches between sentence ends and line ends."""
    return [(m.start(), m.end(), tokens) for m in _SENTENCE.finditer(text or "") if (tokens := set(m.group().lower().split()))]


class _Tokens(dict):
    """Weights of tokens, made when they are first met; emptied when there are too many."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, token: str) -> float:
        if len(self) >= _KNOWN:
            self.clear()
        value = self[token] = sum(self.weights.get(f, 0.0) for f in features(token))
        return value


class NoisyOr:
    """Word weights and bias; score(text) and locate(text)."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias

    #: The tokens of the model that was last used in this process: Python workers outlive their models.
    _known: dict[str, float] = {}
    _owner = None

    def logits(self, text: str | None) -> list[tuple[int, int, float]]:
        if NoisyOr._owner is not self:
            NoisyOr._owner, NoisyOr._known = self, _Tokens(self.weights)
        weight = NoisyOr._known.__getitem__
        return [(a, b, self.bias + sum(map(weight, tokens))) for a, b, tokens in sentences(text)]

    def score(self, text: str | None) -> float:
        z = np.array([x for _, _, x in self.logits(text)])
        return float(-np.expm1(-np.logaddexp(0, z).sum())) if len(z) else 0.0

    def locate(self, text: str | None, at_least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences that offend by themselves."""
        return [(a, b, p) for a, b, z in self.logits(text) if (p := float(1 / (1 + np.exp(-z)))) >= at_least]


def fit(bags: list[list[list[int]]], labels: np.ndarray, epochs: int = EPOCHS, shrink: float = SHRINK, bias_rate: float = BIAS_RATE) -> NoisyOr:
    """bags: for each document the features of each sentence. Without a toxic example nothing is toxic."""
    labels = np.asarray(labels, float)
    if not len(bags) or not labels.any():
        return NoisyOr({}, START * 3)
    by_doc = [np.unique(np.concatenate([np.asarray(s, np.int64) for s in bag])) if bag else np.zeros(0, np.int64) for bag in bags]
    names, seen = np.unique(np.concatenate(by_doc), return_counts=True)
    names = names[seen >= min(LEAST_DOCS, max(1, len(bags) // 50))]
    flat = np.concatenate([np.asarray(s, np.int64) for bag in bags for s in bag])
    sizes = np.array([len(s) for bag in bags for s in bag])
    doc_of = np.repeat(np.arange(len(bags)), [len(bag) for bag in bags])
    sentence_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    at = np.minimum(np.searchsorted(names, flat), len(names) - 1).astype(np.int32)
    known = names[at] == flat
    at, sentence_of = at[known], sentence_of[known]
    weights, bias, squares, bias_square = np.zeros(len(names)), START, np.full(len(names), 1e-3), 1e-3
    n = np.array([max(1, (labels == y).sum()) for y in (0, 1)], float)
    share = np.where(labels == 1, 0.5 / n[1], 0.5 / n[0])
    for _ in range(epochs):
        z = bias + np.bincount(sentence_of, weights[at], len(sizes))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        total = np.bincount(doc_of, np.logaddexp(0, z), len(bags))
        pull = np.where(labels == 1, -1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-3), 1.0) * share
        slope = pull[doc_of] * p
        grad = np.bincount(at, slope[sentence_of], len(names)) + DECAY * weights / len(bags)
        squares += grad * grad
        weights -= RATE * grad / np.sqrt(squares + 1e-12)
        weights = np.sign(weights) * np.maximum(np.abs(weights) - RATE * shrink / np.sqrt(squares + 1e-12), 0)
        step = slope.sum()
        bias_square += step * step
        bias -= bias_rate * step / np.sqrt(bias_square)
    kept = np.abs(weights) > 1e-3
    return NoisyOr(dict(zip(names[kept].tolist(), weights[kept].tolist(), strict=True)), float(bias))


def cross_validated(bags: list, labels: np.ndarray, folds: int = 5, **settings) -> dict[str, float]:
    """Of documents that a fit on the other folds has not seen: the log-loss, classes weighing the same, and the shares of
    toxic ones missed and clean ones accused. SHRINK and BIAS_RATE were chosen by it among training rows only."""
    labels, safe = np.asarray(labels), np.zeros(len(bags))  # safe: minus the logarithm of the chance that nothing offends
    for k in range(folds):
        own = np.arange(len(bags)) % folds == k
        model = fit([x for x, out in zip(bags, own, strict=True) if not out], labels[~own], **settings)
        for i in np.flatnonzero(own):
            z = np.array([model.bias + sum(model.weights.get(f, 0.0) for f in np.asarray(s).tolist()) for s in bags[i]])
            safe[i] = np.logaddexp(0, z).sum()
    toxic = labels == 1
    loss = np.where(toxic, -np.log(np.maximum(-np.expm1(-safe), 1e-12)), safe)
    return {"loss": float(loss[toxic].mean() + loss[~toxic].mean()) / 2, "missed": float((safe[toxic] < np.log(2)).mean()), "accused": float((safe[~toxic] >= np.log(2)).mean())}


def training_bags(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, most_chars: int = MOST_CHARS) -> tuple[list, np.ndarray]:
    """Features of each sentence of each document of the bounded sample, made by the executors, and the labels."""
    bounded_batches(docs.sparkSession)
    kind = T.ArrayType(T.ArrayType(T.IntegerType()))

    @F.pandas_udf(kind)
    def bag(texts):
        import pandas as pd

        return pd.Series([[[f for t in tokens for f in features(t)] for _, _, tokens in sentences(x)] for x in texts])

    rows = with_labels(docs, labels, label_col, per_class, id_col, text_col, most_chars)
    got = rows.select(id_col, "label", bag(F.col("text")).alias("bag")).toArrow().sort_by(id_col)
    bags, y = [], got["label"].to_numpy()
    for chunk in got["bag"].chunks:
        for i in range(len(chunk)):
            inner = chunk[i].values
            flat, offsets = inner.values.to_numpy(zero_copy_only=False), inner.offsets.to_numpy()
            bags.append([flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    return bags, y


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, most_chars: int = MOST_CHARS) -> NoisyOr:
    """Fits on the bounded sample."""
    return fit(*training_bags(docs, labels, label_col, id_col, text_col, per_class, most_chars))


def score_documents(docs: DataFrame, model: NoisyOr, text_col: str = "text", locate: bool = True, into: str = "toxicity") -> DataFrame:
    """docs with a column into: struct(score, predicted, offending: array of struct(start, end, probability)).

    Null and empty texts score 0. Whole texts are read. predicted is 1 from a score of 0.5. A column of docs named as into
    is replaced; others stay. Without locate, offending is empty. Repeated rows stay, an empty table stays empty.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample's features
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("probability", T.DoubleType())])
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("offending", T.ArrayType(span))])

    @F.pandas_udf(kind)
    def judge(texts):
        import pandas as pd

        noisy_or, out = shared.value, []
        for text in texts:
            score = noisy_or.score(text)
            spans = [dict(zip(("start", "end", "probability"), s, strict=True)) for s in noisy_or.locate(text)] if locate and score >= 0.5 else []
            out.append((score, int(score >= 0.5), spans))
        return pd.DataFrame(out, columns=["score", "predicted", "offending"]).astype({"score": "float64", "predicted": "int32"})

    return docs.withColumn(into, judge(F.col(text_col).cast("string")))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "toxicity.score", "toxicity.predicted", F.size("toxicity.offending").cast("long").alias("n_offending"))
