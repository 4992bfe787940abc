"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

``P(grade >= j) = sigmoid(w . x - theta_j)`` with one weight vector ``w`` for all ordered thresholds; the output is the
expected severity, the sum of these probabilities over ``j >= 1``.

The labels given are binary, so grades are derived: 0 is not toxic; toxic documents are graded 1 or 2 by whether the
number of their toxic-typical words is at most, or above, its median among toxic documents.  Features say which words
occur; the vocabulary is every word whose presence and the label are associated (z-score over all labelled documents of
the sample), which keeps long documents from adding up noise.

``SAMPLE`` labelled documents at most (those with the smallest hash of their id) are used to fit; the bound is the
parameter ``sample``. All documents are scored.

Defined results: a null text has no words and gets the model's base severity; labels that are null or without a document
are ignored; without both kinds of labels the severity is 0 for every document; repeated documents are each scored, and of
those that share a labelled id the least text in byte order is fitted on; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.text import alnum_words
from logweave.plans.session import scratch, ship_package, written

SAMPLE = 20_000
GRADES = 3


@dataclass
class SeverityModel:
    """Word weights, the ascending thresholds of grades 1, 2, ..., and the probability from which a text counts as toxic."""

    weights: dict[bytes, float]
    thresholds: list[float]
    cut: float = 0.5

    def severity(self, words: set[bytes]) -> tuple[float, float]:
        """Expected severity and the probability of grade 1 or more."""
        score = sum(self.weights[w] for w in self.weights.keys() & words)
        above = [1 / (1 + math.exp(min(50.0, max(-50.0, t - score)))) for t in self.thresholds]
        return sum(above), above[0] if above else 0.0


def fit_ordinal(rows: list[tuple[int, list[int]]], n_features: int, grades: int = GRADES, ridge: float = 1.0, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds for rows of (grade, present features), by accelerated gradient descent on the penalised likelihood."""
    y = np.array([g for g, _ in rows])
    at = np.repeat(np.arange(len(rows)), [len(f) for _, f in rows])
    cols = np.array([c for _, f in rows for c in f], dtype=np.int64)
    w = np.zeros(n_features)
    share = [min(max((y >= j).mean(), 1e-4), 1 - 1e-4) for j in range(1, grades)]
    # theta_1 and the logs of the gaps keep thresholds in order.
    theta1, gaps = -math.log(share[0] / (1 - share[0])), np.array([math.log(max(1e-2, math.log(share[j] / (1 - share[j])) - math.log(share[j + 1] / (1 - share[j + 1])))) for j in range(len(share) - 1)])
    state = np.concatenate([w, [theta1], gaps])
    ahead, speed, rate = state.copy(), 1.0, 1.0
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))

    def loss_and_slope(s):
        w, t = s[:n_features], s[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(s[n_features + 1 :]))])
        eta = np.bincount(at, weights=w[cols], minlength=len(rows))
        upper = np.column_stack([np.ones(len(rows)), *[sigmoid(eta - x) for x in t], np.zeros(len(rows))])
        each = np.arange(len(rows))
        p = np.maximum(upper[each, y] - upper[each, y + 1], 1e-12)
        d = upper * (1 - upper)
        slope_eta = -(d[each, y] - d[each, y + 1]) / p
        slope_t = np.zeros(len(t))
        for j in range(len(t)):
            slope_t[j] = ((d[each, y] / p)[y == j + 1]).sum() - ((d[each, y + 1] / p)[y == j]).sum()
        slope = np.concatenate([np.bincount(cols, weights=slope_eta[at], minlength=n_features) + ridge * w, [slope_t.sum()], [slope_t[j + 1 :].sum() * math.exp(s[n_features + 1 + j]) for j in range(len(t) - 1)]])
        return -np.log(p).sum() + ridge / 2 * (w @ w), slope

    for _ in range(steps):
        value, slope = loss_and_slope(ahead)
        while True:  # backtracking: the step shrinks until it improves as much as the slope promises
            new = ahead - rate / len(rows) * slope
            if loss_and_slope(new)[0] <= value - rate / len(rows) / 2 * (slope @ slope) or rate < 1e-9:
                break
            rate /= 2
        following = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        ahead, state, speed, rate = new + (speed - 1) / following * (new - state), new, following, rate * 1.3
    return state[:n_features], state[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(state[n_features + 1 :]))])


def fit_severity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> SeverityModel:
    """Select the vocabulary from the labelled sample, read its presence, and fit."""
    ship_package(docs.sparkSession)
    with scratch(docs.sparkSession) as folder:
        return _fitted(docs, labels, key, text, label, sample, folder)


def _fitted(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int, folder: str) -> SeverityModel:
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("k"), "k").limit(sample)  # at most `sample` rows of two numbers
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("body")).join(F.broadcast(chosen), "k")
    # One text for each labelled id, so that what is collected stays within the sample; documents are read once for it.
    rows = written(rows.groupBy("k").agg(F.first("toxic").alias("toxic"), F.min("body").alias("body")).select("toxic", "body"), "labelled", folder)

    def words(batches):
        for batch in batches:
            found = [sorted(set(alnum_words(b.as_py()))) for b in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["toxic", "words"])

    counted = rows.mapInArrow(words, "toxic int, words array<binary>")
    total = rows.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in total}
    if not n.get(0) or not n.get(1):
        return SeverityModel({}, [])
    share = n[1] / (n[0] + n[1])
    each = counted.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"), F.sum("toxic").alias("hits"))
    z = (F.col("hits") - F.col("df") * share) / F.sqrt(F.col("df") * share * (1 - share) + 1e-9)
    kept = each.where("df >= 4").withColumn("z", z).where("abs(z) >= 4").orderBy(F.abs("z").desc(), "word").collect()  # words that four of the sampled texts hold
    vocabulary = {bytes(r["word"]): i for i, r in enumerate(kept)}
    typical = {i for i, r in enumerate(kept) if r["z"] > 0}
    if not vocabulary:
        return SeverityModel({}, [])
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def presence(batches):
        for batch in batches:
            own = [sorted(held.value[w] for w in held.value.keys() & set(alnum_words(b.as_py()))) for b in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int32()))], ["toxic", "features"])

    data = [(r["toxic"], r["features"]) for r in rows.mapInArrow(presence, "toxic int, features array<int>").collect()]
    amounts = sorted(len(typical.intersection(f)) for t, f in data if t)
    middle = amounts[len(amounts) // 2]
    graded = [(t + int(bool(t) and len(typical.intersection(f)) > middle), f) for t, f in data]
    grades = 3 if any(g == 2 for g, _ in graded) else 2
    weights, thresholds = fit_ordinal(graded, len(vocabulary), grades)
    p = [1 / (1 + math.exp(thresholds[0] - weights[f].sum())) for _, f in data]
    return SeverityModel({w: float(weights[i]) for w, i in vocabulary.items()}, [float(t) for t in thresholds], best_cut(p, [bool(t) for t, _ in data]))


def best_cut(p: list[float], toxic: list[bool]) -> float:
    """The probability between two scores that tells toxic from other texts best on the sample, 0.5 at most.

    Best is by F-measure with precision counting twice as much as recall, so that clean texts are left alone.
    """
    pairs = sorted(zip(p, toxic, strict=True), reverse=True)
    best, cut, hits, total = 0.0, 0.5, 0, sum(toxic)
    for n, (score, label) in enumerate(pairs, 1):
        hits += label
        following = pairs[n][0] if n < len(pairs) else 0.0
        measure = 1.25 * hits / (n + 0.25 * total)
        if following < score and measure > best:
            best, cut = measure, (score + following) / 2
    return min(0.5, cut)


def score_severity(docs: DataFrame, model: SeverityModel, key: str = "doc_id", text: str = "text", threshold: float | None = None) -> DataFrame:
    """One row per document: ``key, expected_severity, p_toxic, grade`` (rounded severity) and ``toxic`` (``p_toxic`` at least ``threshold``, the model's own by default)."""
    ship_package(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        own = held.value
        for batch in batches:
            out = [own.severity(set(alnum_words(b.as_py()))) for b in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([round(a, 6) for a, _ in out], pa.float64()), pa.array([round(b, 6) for _, b in out], pa.float64())], ["k", "expected_severity", "p_toxic"])

    scored = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("body")).mapInArrow(rows, f"k {dict(docs.dtypes)[key]}, expected_severity double, p_toxic double")
    return scored.select(F.col("k").alias(key), "expected_severity", "p_toxic", F.round("expected_severity").cast("int").alias("grade"), (F.col("p_toxic") >= (model.cut if threshold is None else threshold)).alias("toxic"))
