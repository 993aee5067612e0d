"""Quality classifier: naive Bayes support vectors.

n-gram indicators are scaled by their class log-count ratio, and a linear hinge-loss model is fitted on them by dual
coordinate descent. n-grams are taken over words and over word shapes, where a word equal to the one before it has a
shape of its own; so broken tables, symbol noise and stuttering show as short shape n-grams in any language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import DataFrame, functions as F

from folioquery.llm.common import WordHashes, held_out, mix, worker_state
from folioquery.llm.labels import fit_sample
from folioquery.llm.linear import platt

DIMENSIONS = 1 << 18
FIT_ROWS = 12_000   # labelled rows the model is fitted on, chosen by a hash of the id
SMOOTHING = 1.0
COST = 1.0          # upper bound of a dual variable
EPOCHS = 12
RUNS = re.compile(rb"[a-z\x80-\xff]+|[0-9]+")
ODD, EVEN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class ShapeHashes(WordHashes):
    """Hash of a word's shape: runs of letters and of digits shrink to one sign, others stay; capitals are kept apart."""

    def __missing__(self, word: bytes) -> int:
        case = b"A" if word.isupper() and len(word) > 1 else b"a"
        shape = RUNS.sub(lambda m: b"0" if m[0].isdigit() else case, word.lower())
        value = WordHashes(0)[b"\0" + shape]
        if len(self) < self.most:
            self[word] = value
        return value


def indicators(text: str, words: WordHashes, shapes: ShapeHashes) -> np.ndarray:
    """Sorted distinct dimensions of a text's word 1- and 2-grams and shape 1- to 3-grams."""
    tokens = text.encode().split()
    if not tokens:
        return np.zeros(0, dtype=np.int32)
    w, s = words.of([t.lower() for t in tokens]), shapes.of(tokens)
    s[1:][w[1:] == w[:-1]] = np.uint64(77)
    grams = [w, w[1:] * ODD + w[:-1], s, s[1:] * ODD + s[:-1] + np.uint64(1),
             (s[2:] * ODD + s[1:-1]) * EVEN + s[:-2]]
    return np.unique(mix(np.concatenate(grams)) & np.uint64(DIMENSIONS - 1)).astype(np.int32)


def indicator_maker():
    words, shapes = worker_state(("quality words",), lambda: (WordHashes(), ShapeHashes()))
    return lambda text: indicators(text or "", words, shapes)


@dataclass
class Model:
    """Margin = (weights over the indicators) / (norm of the scaled indicators) + bias; score = sigmoid of a line."""
    weights: np.ndarray
    ratio_squared: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, features: np.ndarray) -> float:
        if not len(features):
            return self.bias
        norm = float(self.ratio_squared[features].sum()) ** 0.5
        return float(self.weights[features].sum()) / (norm or 1.0) + self.bias

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features) + self.offset, -30, 30))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = [np.full(DIMENSIONS, SMOOTHING) for _ in range(2)]
    for features, label in zip(rows, labels):
        counts[int(label)][features] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray) -> tuple[np.ndarray, float]:
    """L1-loss linear SVM: one dual variable at a time, in a fixed shuffled order, the bias as an extra feature."""
    weights, bias, dual = np.zeros(DIMENSIONS), 0.0, np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        largest = 0.0
        for i in rng.permutation(len(rows)).tolist():
            gradient = signs[i] * (float(weights[rows[i]] @ values[i]) + bias) - 1
            step = min(max(dual[i] - gradient / square[i], 0.0), COST) - dual[i]
            if step:
                dual[i] += step
                weights[rows[i]] += step * signs[i] * values[i]
                bias += step * signs[i]
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``fit_rows`` labelled rows; what reaches the driver is bounded by fit_rows x DIMENSIONS ids.

    Without a row of each class the model is neutral: every score is the share of label 1, or 0.5 without labels.
    """
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = indicator_maker()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array([make(x) for x in batch.column("text").to_pylist()], pa.list_(pa.int32()))],
                ["label", "features"])

    sample = fit_sample(docs, labels, column, fit_rows).select("doc_id", "text", "label")
    table = sample.mapInArrow(features, "label int, features array<int>").toArrow()
    y = table["label"].to_numpy().astype(np.int64)
    rows = [x.values.to_numpy() for x in table["features"]]
    if len(set(y.tolist())) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        return Model(np.zeros(DIMENSIONS), np.ones(DIMENSIONS), 0.0, 1.0, float(np.log(share / (1 - share))))
    ratio = log_count_ratios(rows, y)
    norms = [float((ratio[r] ** 2).sum()) ** 0.5 or 1.0 for r in rows]
    values = [ratio[r] / n for r, n in zip(rows, norms)]
    weights, bias = dual_coordinate_descent(rows, values, 2.0 * y - 1)
    model = Model(weights * ratio, ratio ** 2, bias, 1.0, 0.0)
    model.slope, model.offset = platt(np.array([model.margin(r) for r in rows]), y)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score every whole text; one row per input row, a null or empty text included. No shuffle."""
    state = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.ratio_squared.astype(np.float32)))
    bias, slope, offset = model.bias, model.slope, model.offset

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = indicator_maker()
        fitted = Model(*state.value, bias, slope, offset)
        for batch in batches:
            scores = [fitted.score(make(x.as_py())) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64())],
                                             ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    return score(docs, fit(docs, labels, fit_rows=fit_rows))
