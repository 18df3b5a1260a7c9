"""Quality classifier by Bradley-Terry pairwise ranking (operator 2).

A document's score is linear in measures of its text. The weights maximise the probability
that in preference pairs, one document of each label, the better one wins: the
logistic loss on the difference of the two feature rows. The threshold is the quantile of the
learned scores that parts the labels of the sample best; there the score is 0.7.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import held_out, table

#: At most so many labelled rows are learned from, those with the smallest hash of their id.
SAMPLE = 20_000
PAIRS = 200_000
THRESHOLD = 0.7
# classes of bytes: 0 other symbol, 1 lower case, 2 upper case, 3 digit, 4 space, 5 line end, 6 sentence mark, 7 beyond ASCII
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[9, 11, 12, 32]], _KIND[[10, 13]], _KIND[128:] = 1, 2, 3, 4, 5, 7
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 6
N_FEATURES = 17


def features(text: str) -> list[float]:
    """N_FEATURES measures of a whole text, all finite; those of an empty one are 0."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * N_FEATURES
    n = np.bincount(_KIND[np.frombuffer(raw, dtype=np.uint8)], minlength=8) / len(raw)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    length = len(words)
    ends = Counter(w[-1] for w in words)
    odd_end = sum(k for c, k in ends.items() if _KIND[c] == 0) / length
    line_copies = 1.0 - len(set(lines)) / len(lines)
    mean = sum(map(len, words)) / length
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, length - 1)
    return [
        math.log1p(length), mean, math.log1p(length / len(lines)), n[0], n[2], n[3], n[5], n[6], n[7], n[4],
        len(counts) / length, pairs, counts.most_common(1)[0][1] / length, odd_end, line_copies,
        sum(k for w, k in counts.items() if len(w) <= 3) / length, float(n[0] > 0.02),
    ]


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7, steps: int = 60, ridge: float = 1e-3) -> dict:
    """Weights from rows ``x`` with labels ``y`` (0, 1): mean, scale, w, and cut, the score at the threshold."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z, good, bad = (x - mean) / scale, np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng, w = np.random.default_rng(seed), np.zeros(x.shape[1])
    diff = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
    for _ in range(steps):  # Newton steps on the logistic loss
        p = 1.0 / (1.0 + np.exp(-np.clip(diff @ w, -30, 30)))
        grad = diff.T @ (p - 1.0) / len(diff) + ridge * w
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    scores = z @ w
    levels = np.quantile(scores, np.linspace(0, 1, 401))
    right = [((scores >= t) == (y == 1)).mean() for t in levels]
    best = np.flatnonzero(np.array(right) >= max(right) - 1e-12)
    return {"mean": mean, "scale": scale, "w": w, "cut": float(levels[best].mean())}


def score_rows(x: np.ndarray, model: dict) -> np.ndarray:
    if model["w"] is None:
        return np.full(len(x), model["prior"])
    raw = (x - model["mean"]) / model["scale"] @ model["w"] - model["cut"] + math.log(THRESHOLD / (1 - THRESHOLD))
    return 1.0 / (1.0 + np.exp(-np.clip(raw, -500, 500)))


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [features(t.as_py() or "") for t in b.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1)], ["x", "y"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """A model from at most ``sample`` labelled rows of learnable documents.

    Without a row of either label there are no pairs; the model then scores every text with
    the share of label 1 (0.5 without labels).
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("y")).where("_id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("_id")))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "y").limit(sample)
    joined = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "_id")  # at most ``sample`` rows
    got = joined.select("text", "y").mapInArrow(measured, "x array<double>, y int").toPandas()
    y = got["y"].to_numpy(dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return {"w": None, "prior": float(y.mean()) if len(y) else 0.5}
    return fit(np.stack(got["x"].to_numpy()), y)


def score(docs: DataFrame, model: dict, spark: SparkSession) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null text counts as empty; empty texts have a score like any other. Equal texts score alike,
    repeated rows stay, other columns are not read, an empty table gives an empty result.
    """
    shared = spark.sparkContext.broadcast(model)  # a few dozen numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score_rows(np.array([features(t.as_py() or "") for t in b.column(2)]).reshape(-1, N_FEATURES), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: dict, spark: SparkSession) -> DataFrame:
    """The rows of ``docs``, all columns, whose text reaches the threshold."""
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score_rows(np.array([features(t.as_py() or "") for t in b.column(at)]).reshape(-1, N_FEATURES), shared.value)
            yield b.filter(pa.array(s >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")), spark)
