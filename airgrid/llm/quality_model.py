"""Naive Bayes support vector machine over byte n-gram indicators.

Indicators are scaled by the log-count ratio of their class, rows are brought to length one, and a linear hinge-loss model
is fitted by dual coordinate descent.  Margins become scores by a logistic curve fitted on rows the model did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from airgrid.llm.catalog import register, table
from airgrid.llm.tasks import slices

BITS = 18  # features: n-grams hashed into 2**BITS places
ORDERS = (2, 3, 4)  # lengths of the n-grams in bytes
FIT_ROWS = 6000  # bound of the labelled rows the model is fitted on, chosen by the hash of their doc_id
CALIBRATION_SHARE = 4  # every fourth of them fits the logistic curve instead
PENALTY, EPOCHS, SMOOTHING = 4.0, 12, 1.0
THRESHOLD = 0.3
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


# Word bigrams of twice the same word share places: one for 1, 2, 4, 8, ... of them in a text.
DOUBLED = np.arange(64) * 4001 + 17


def features(text: bytes) -> np.ndarray:
    """Places of the n-grams that occur in a text, ascending."""
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    found = np.zeros(1 << BITS, bool)
    code = data
    for order in range(2, max(ORDERS) + 1):
        if len(data) < order:
            break
        code = (code[:-1] << np.uint64(8)) | data[order - 1:]
        if order in ORDERS:
            with np.errstate(over="ignore"):
                found[((code + np.uint64(order << 40)) * MULTIPLIER) >> np.uint64(64 - BITS)] = True
    words = text.split()
    doubled = sum(map(eq, words, words[1:]))
    found[DOUBLED[:doubled.bit_length()]] = True
    return np.flatnonzero(found).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray  # margin weight of a feature, the log-count ratio included
    ratios: np.ndarray  # the log-count ratios, for a row's length
    bias: float
    slope: float
    shift: float

    def margin(self, text: bytes) -> float:
        idx = features(text)
        length = np.sqrt(np.square(self.ratios[idx], dtype=np.float64).sum())
        return float(self.weights[idx].sum(dtype=np.float64) / length) + self.bias if length else self.bias

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(text) + self.shift, -500, 500))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = np.full((2, 1 << BITS), SMOOTHING)
    for idx, y in zip(rows, labels):
        counts[int(y > 0), idx] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def descend(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss, classes weighted to equal sums; the bias is a constant input."""
    inverse = np.array([1 / max(np.linalg.norm(ratios[idx]), 1e-12) for idx in rows])
    weight = {s: PENALTY * len(labels) / (2 * max(1, (labels == s).sum())) for s in (-1, 1)}
    cap = np.array([weight[int(y)] for y in labels])
    w, bias, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            idx, y = rows[i], labels[i]
            x = ratios[idx] * inverse[i]
            gradient = y * (w[idx] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / (x @ x + 1), 0.0), cap[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                w[idx] += step * x
                bias += step
                alpha[i] = new
    return w, bias


def logistic_fit(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method on smoothed targets."""
    high, low = (labels > 0).sum(), (labels < 0).sum()
    target = np.where(labels > 0, (high + 1) / (high + 2), 1 / (low + 2))
    x, theta = np.column_stack([margins, np.ones(len(margins))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p))
        theta = theta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def fit(texts: list[bytes], labels: list[int]) -> Model:
    """A model of labels 0 and 1; with one class only, or no rows, a model that gives every text that class's share."""
    y = np.where(np.array(labels, int) > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        share = (float((y > 0).sum()) + 1) / (len(y) + 2)
        zero = np.zeros(1 << BITS, np.float32)
        return Model(zero, zero, 0.0, 0.0, float(np.log(share / (1 - share))))
    rows = [features(t) for t in texts]
    held = np.arange(len(y)) % CALIBRATION_SHARE == 0
    if min((y[held] > 0).sum(), (y[held] < 0).sum(), (y[~held] > 0).sum(), (y[~held] < 0).sum()) < 5:
        held = np.zeros(len(y), bool)
    used = [r for r, h in zip(rows, held) if not h]
    ratios = log_count_ratios(used, y[~held])
    w, bias = descend(used, y[~held], ratios)
    model = Model((w * ratios).astype(np.float32), ratios.astype(np.float32), bias, 1.0, 0.0)
    seen = held if held.any() else ~held
    margins = np.array([model.margin(t) for t, s in zip(texts, seen) if s])
    model.slope, model.shift = logistic_fit(margins, y[seen])
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents outside the held-out fifth.

    A doc_id with several labels counts as 1 if half of them or more are 1; null labels and ids are left out.  The chosen
    ids are at most ``rows``, so they may be broadcast; the texts are fitted in one task of bounded size.
    """
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(
        (F.avg(F.col("quality")) >= 0.5).cast("int").alias("label")).orderBy(order, "doc_id").limit(rows)

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        rows = pd.concat(frames).sort_values(["key", "text"]) if frames else pd.DataFrame({"text": [], "label": []})
        rows = rows.drop_duplicates("key") if frames else rows
        m = fit([t or b"" for t in rows.text], rows.label.tolist())
        yield pd.DataFrame({"weights": [m.weights.tobytes()], "ratios": [m.ratios.tobytes()], "bias": [m.bias], "slope": [m.slope], "shift": [m.shift]})

    texts = docs.select("doc_id", F.encode("text", "UTF-8").alias("text")).join(F.broadcast(chosen), "doc_id").select(
        order.alias("key"), "text", "label")
    rows = texts.repartition(1).mapInPandas(fitted, "weights binary, ratios binary, bias double, slope double, shift double").head(1)
    if not rows:  # no task had a row
        return fit([], [])
    row = rows[0]
    return Model(np.frombuffer(row.weights, np.float32), np.frombuffer(row.ratios, np.float32), row.bias, row.slope, row.shift)


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row with ``score`` (higher: label 1 likelier); a null text is scored as an empty one.

    Raises ValueError if ``docs`` has a column ``_text`` or ``score``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB, whatever the input
    keep = docs.columns
    if "_text" in keep or "score" in keep:
        raise ValueError("columns _text and score are made here")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            scores = pa.array([sent.value.score(t) for t in batch.column("_text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], scores], [*keep, "score"])

    kinds = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    return docs.withColumn("_text", F.encode(F.coalesce("text", F.lit("")), "UTF-8")).mapInArrow(scored, kinds)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores and predictions of all rows, held-out ones marked; a null doc_id is not held out."""
    model = train(docs, labels)
    return score(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@register("op5_nb_support_vectors")
def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
