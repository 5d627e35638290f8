"""Operator 9: Bradley-Terry quality scores.

Documents are players: from pairs (better, worse) of labelled rows a weight vector w is learnt such that
P(better beats worse) = sigmoid(w . (f(better) - f(worse))), f being features of the whole text. The raw score of any
document is w . f(text). The threshold is a quantile of the training rows' raw scores, at the share of label 0 among
them, and the published score is sigmoid(raw - threshold), shifted so that the threshold is 0.7.

Bounds: ``SAMPLE_ROWS`` labelled rows, chosen by hash of doc_id, train the model on the driver; ``PAIRS`` preference
pairs are drawn from them. Scoring is one pass over all documents without a shuffle; the model it carries is one vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_table, table

SAMPLE_ROWS, PAIRS, RIDGE, THRESHOLD, SEED = 20_000, 60_000, 1e-3, 0.7, 9

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(text: str | None) -> np.ndarray:
    """Numbers that describe the form of a whole text: its bytes, words and lines. Null counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, len(data))
    bytes_ = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, digits = bytes_[65:91].sum(), bytes_[97:123].sum(), bytes_[48:58].sum()
    words = data.split()
    n = max(1, len(words))
    distinct = len(set(words))
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in data.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    marks = bytes_[list(_PUNCTUATION)]
    form = [
        math.log1p(len(data)), math.log1p(len(words)), lengths.mean(), lengths.std(), math.log1p(lengths.max()),
        upper / max(1, upper + lower), digits / size, bytes_[128:].sum() / size, (bytes_[32] + bytes_[10]) / size, marks.sum() / n,
        distinct / n, repeats / n, pairs / n, math.log(distinct + 1) / math.log(n + 1),
        len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)), float(not words),
    ]
    return np.array([*form, *np.minimum(1.0, marks / n)], np.float64)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        raw = np.clip((rows - self.mean) / self.scale, -8, 8) @ self.weights
        shift = math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(raw - self.threshold + shift, -500, 500)))


def fit(rows: np.ndarray, labels: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE) -> Model | None:
    """Weights by Newton steps on the logistic loss of feature differences; None unless both labels occur."""
    good, bad = rows[labels == 1], rows[labels == 0]
    if not len(good) or not len(bad):
        return None
    mean, scale = rows.mean(0), np.maximum(rows.std(0), 1e-6)
    draw = np.random.default_rng(SEED)
    better, worse = (np.clip((x - mean) / scale, -8, 8) for x in (good, bad))
    gaps = better[draw.integers(len(better), size=pairs)] - worse[draw.integers(len(worse), size=pairs)]
    weights = np.zeros(rows.shape[1])
    for _ in range(25):
        chance = 1 / (1 + np.exp(-np.clip(gaps @ weights, -500, 500)))
        slope = gaps.T @ (chance - 1) / pairs + ridge * weights
        bend = (gaps * (chance * (1 - chance))[:, None]).T @ gaps / pairs + ridge * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    raw = np.clip((rows - mean) / scale, -8, 8) @ weights
    return Model(mean, scale, weights, float(np.quantile(raw, (labels == 0).mean(), method="midpoint")))


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on at most ``sample_rows`` labelled rows that are not held out. Null labels and ids are left aside."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(batch.column(1)[i].as_py()).tolist() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64())), batch.column(2)], names=["doc_id", "f", "quality"])

    rows = texts.mapInArrow(run, "doc_id long, f array<double>, quality int").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "f").limit(sample_rows).collect()
    if not rows:
        return None
    return fit(np.array([r.f for r in rows]), np.array([r.quality for r in rows]))


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs`` (doc_id, text).

    Null and empty texts are scored by their features like any other. Without a model (no labelled row, or one label only) nothing
    is known to be worse than anything else: every score is the threshold itself. Rows keep null and repeated doc_ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, texts = batch.num_rows, batch.column(1)
            scores = model.score(np.array([features(texts[i].as_py()) for i in range(n)])) if model and n else np.full(n, THRESHOLD)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out())
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their columns as they were."""
    if model is None:
        return docs

    @F.pandas_udf("double")
    def score(texts):
        return _series(model.score(np.array([features(x) for x in texts])) if len(texts) else [])

    return docs.filter(score(F.col("text").cast("string")) >= THRESHOLD)


def _series(values):
    import pandas as pd

    return pd.Series(values, dtype="float64")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
