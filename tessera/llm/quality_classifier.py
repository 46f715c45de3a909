"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed word unigrams, word bigrams, word endings (three bytes) and doubled words. Each is scaled by the
log-count ratio of the two classes, and a linear hinge-loss model is fitted by dual coordinate descent. Its weights are
interpolated with their mean size, as is usual for this model, and a logistic curve over the margins of the training
rows, weighted to the class shares of all labels outside the held-out fold, turns margins into scores. Fitting uses at
most `max_train` labelled rows (the smallest hashes of doc_id, each class up to half where it has so many) with at most
`max_bytes` of features together, so what reaches the driver is bounded; scoring is one pass without a shuffle over every row.

Defined cases: a null or empty text has no features and gets the score of the bias alone. Without labelled rows of both
classes every score is the share of label 1 (0.5 without any). Labels of one doc_id that disagree count as their
smallest. Rows that repeat get the same score. The score reads the text only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import smallest_hashes, stored
from tessera.llm._text import RangeHash, Texts, U, mix, texts
from tessera.llm.quality_rules import bigrams

BITS = 18
DOUBLED = 0  # bucket of a bigram of twice the same word, whatever the word
FOLDS = 5


def features(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs of a chunk, ordered by text and feature."""
    words, hashes = t.words(), RangeHash(t.buf)
    h = hashes.of(words.start, words.end)
    pairs, pair_text = bigrams(words, h)
    ends = mix(hashes.raw(np.maximum(words.start, words.end - 3), words.end) + U(7))
    doubled = words.text[1:][(h[1:] == h[:-1]) & (words.text[1:] == words.text[:-1])]
    feature = (np.concatenate([h, pairs, ends]) >> U(64 - BITS)).astype(np.int64)
    feature = np.concatenate([feature, np.full(len(doubled), DOUBLED)])
    keys = np.concatenate([words.text, pair_text, words.text, doubled]) << BITS | feature
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return keys >> BITS, keys & ((1 << BITS) - 1)


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learnt from: crc32 of the id as text divisible by FOLDS. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


@dataclass
class Model:
    """Margin = bias + mean weight of a text's distinct features; score = logistic(slope * margin + offset)."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, text: Column | str) -> Column:
        weights, bias, slope, offset = self.weights, self.bias, self.slope, self.offset

        @F.arrow_udf("double")
        def scored(column: pa.Array) -> pa.Array:
            made = [np.empty(0)]
            for t in texts(column):
                own, feature = features(t)
                n = np.sqrt(np.maximum(np.bincount(own, minlength=len(t)), 1))
                margin = np.bincount(own, weights[feature], minlength=len(t)) / n + bias
                made.append(1 / (1 + np.exp(-np.clip(slope * margin + offset, -500, 500))))
            return pa.array(np.concatenate(made))

        return scored(text)


def training_ids(labels: DataFrame, max_train: int) -> DataFrame:
    """At most max_train labelled ids outside the held-out fold: half of each class by the smallest hashes."""
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    half = lambda q: smallest_hashes(known.where(F.col("quality") == q), "doc_id", max_train // 2)
    return half(0).unionByName(half(1))


def training_rows(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, max_train: int, max_bytes: int) -> list[tuple[np.ndarray, int]]:
    """(features, label) of the training rows, ordered by id: those with the smallest hashes of the id, up to max_bytes of features."""
    chosen = training_ids(labels, max_train).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label"))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for t in texts(batch.column(1)):
                own, feature = features(t)
                cut = np.searchsorted(own, np.arange(len(t) + 1))
                packed = [feature[a:b].astype("<i4").tobytes() for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(t)), batch.column(2).slice(at, len(t)), pa.array(packed, pa.binary())], ["id", "label", "features"])
                at += len(t)

    # rows of one id are one training row
    read_rows = rows.select("_id", "_text", "_label").mapInArrow(read, "id long, label int, features binary")
    made = stored(read_rows.groupBy("id", "label").agg(F.min("features").alias("features")), "classifier-rows")
    sizes = made.select("id", F.xxhash64("id").alias("h"), F.octet_length("features").alias("n")).toPandas().sort_values(["h", "id"])
    within = sizes["id"][sizes["n"].cumsum() <= max_bytes]
    found = made.where(F.col("id").isin(within.tolist())) if len(within) < len(sizes) else made
    found = found.toPandas().sort_values("id", kind="stable")
    return [(np.frombuffer(f, "<i4"), int(y)) for f, y in zip(found["features"], found["label"])]


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", max_train: int = 6_000, max_bytes: int = 128 << 20, cost: float = 1.0, epochs: int = 12, interpolation: float = 0.9) -> Model:
    """Fit on at most max_train labelled documents outside the held-out fold, with at most max_bytes of features."""
    rows = training_rows(docs, labels, text, doc_id, max_train, max_bytes)
    y = np.array([label for _, label in rows], np.int64)
    n_features = 1 << BITS
    if len(set(y.tolist())) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return Model(np.zeros(n_features), 0.0, 1.0, float(np.log(share / (1 - share))))
    counts = np.zeros((2, n_features))
    for f, label in rows:
        counts[label][f] += 1
    # log-count ratio of indicators, a pseudo-count of one on each side
    ratio = np.log((counts[1] + 1) / (counts[1] + 1).sum()) - np.log((counts[0] + 1) / (counts[0] + 1).sum())
    sign = np.where(y == 1, 1.0, -1.0)
    scaled = [ratio[f] / np.sqrt(max(len(f), 1)) for f, _ in rows]
    w, bias, alpha = np.zeros(n_features), 0.0, np.zeros(len(rows))
    norm = np.array([x @ x + 1 for x in scaled])
    rng = np.random.Generator(np.random.PCG64(5))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f, x = rows[i][0], scaled[i]
            gradient = sign[i] * (w[f] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[f] += step * x
                bias += step
                alpha[i] = new
    w = (interpolation * w + (1 - interpolation) * np.abs(w).mean()) * ratio
    margin = np.array([w[f].sum() / np.sqrt(max(len(f), 1)) + bias for f, _ in rows])
    shares = {r["quality"]: r["n"] for r in labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy("quality").agg(F.count("*").alias("n")).collect()}
    weight = np.where(y == 1, shares[1] / max((y == 1).sum(), 1), shares[0] / max((y == 0).sum(), 1))
    slope, offset = _logistic(margin, y, weight * len(y) / weight.sum())
    return Model(w, bias, slope, offset)


def _logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of a lightly regularised logistic curve, by Newton's method on softened labels."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    aim = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(margin))], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - aim)) + ridge * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def classify(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with a struct column `quality_score`: score and predicted; a column of that name is replaced."""
    out = docs.withColumn("quality_score", F.struct(model.score(F.col(text)).alias("score")))
    return out.withColumn("quality_score", F.col("quality_score").withField("predicted", (F.col("quality_score.score") >= threshold).cast("int")))
