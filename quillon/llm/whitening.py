"""Embedding whitening by Chan merging (operator 11).

Vectors are scaled and rounded down to integers, and each distinct one counts once. Every partition computes count,
local mean and centred scatter of its distinct vectors; ``merge`` joins two such moments, and a tree of reductions
joins those of all partitions, so the driver sees a few matrices of dimension x dimension whatever the
number of vectors. It takes the eigenvectors of the covariance there; a second pass over the distinct vectors
measures how far the covariance of the whitened ones is from the identity.

A mean is kept as its exact sum, so the difference of two means is rounded once, and a vector is centred in integers
before it becomes a double: a large common offset takes no digits from the scatter.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialize, table
from quillon.llm.embed_dedup import by_length, matrix

#: Entries are floor(SCALE * c).
SCALE = 256
#: Components that come back, at most.
COMPONENTS = 4
#: Levels of the reduction tree.
DEPTH = 4
#: Integers are centred as such where they are smaller than this, else as doubles.
SAFE = 1 << 61
OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


class Moments(NamedTuple):
    """Count, sum (Python integers, or doubles for whitened values) and centred scatter of some vectors."""

    n: int
    total: np.ndarray
    scatter: np.ndarray


class Model(NamedTuple):
    """What whitens the vectors of one length: axes has a column for each component, root the square roots of their eigenvalues."""

    n: int
    total: np.ndarray
    axes: np.ndarray
    root: np.ndarray
    explained: np.ndarray


def merge(a: Moments, b: Moments) -> Moments:
    """Chan's formula: the moments of both sets of vectors together."""
    n = a.n + b.n
    gap = ((b.total * a.n - a.total * b.n) / (a.n * b.n)).astype(np.float64)
    return Moments(n, a.total + b.total, a.scatter + b.scatter + np.outer(gap, gap) * (a.n / n * b.n))


def merged(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    """``merge`` for each length that both have."""
    return a | {dim: merge(a[dim], m) if dim in a else m for dim, m in b.items()}


def sums(x: np.ndarray) -> np.ndarray:
    """Exact column sums of 64-bit integers, as Python integers."""
    return (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)


def centred(x: np.ndarray, total: np.ndarray, n: int) -> np.ndarray:
    """Integer rows minus total / n, each difference rounded once."""
    whole = total // n
    rest = ((total - whole * n) / n).astype(np.float64)
    if max(x.max(), whole.max()) < SAFE and min(x.min(), whole.min()) > -SAFE:
        return (x - whole.astype(np.int64)).astype(np.float64) - rest
    return x.astype(np.float64) - whole.astype(np.float64) - rest


def moments(x: np.ndarray) -> Moments:
    """Of one batch of integer rows."""
    total = sums(x)
    c = centred(x, total, len(x))
    return Moments(len(x), total, c.T @ c)


def whitened_moments(y: np.ndarray) -> Moments:
    """Of one batch of whitened rows."""
    total = y.sum(axis=0)
    c = y - total / len(y)
    return Moments(len(y), total, c.T @ c)


def deviations(x: np.ndarray, model: Model) -> pa.Array:
    """Exact sum over dimensions of (n * x - total)^2, as decimal(38,0); null beyond 38 digits."""
    n, total, kind = model.n, model.total, pa.decimal128(38, 0)
    whole = total // n
    near = centred(x, total, n)
    about = (np.square(near * float(n))).sum(axis=1)
    if about.max() < 2.0**61 and max(x.max(), whole.max()) < SAFE and min(x.min(), whole.min()) > -SAFE:
        exact = np.square((x - whole.astype(np.int64)) * n - (total - whole * n).astype(np.int64)).sum(axis=1)
        return pa.array(exact, pa.int64()).cast(kind)
    exact = np.square(x.astype(object) * n - total).sum(axis=1)
    return pa.array([Decimal(int(v)) if v < 10**38 else None for v in exact], kind)


def gathered(vectors: DataFrame, measure: Callable[[int, np.ndarray], Moments | None]) -> dict[int, Moments]:
    """The moments of ``measure(length, rows)`` over all rows of ``vectors(x)``, for each length of x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Moments] = {}
        for b in batches:
            for dim, at in by_length(b.column("x")):
                m = measure(dim, matrix(b.column("x").take(pa.array(at))))
                if m is not None:
                    found = merged(found, {dim: m})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["state"])

    states = vectors.select("x").mapInArrow(run, "state binary").rdd.map(lambda r: pickle.loads(r["state"]))
    return states.treeReduce(merged, depth=DEPTH) if states.getNumPartitions() else {}


def fitted(m: Moments, components: int) -> Model:
    """The model of one length's moments; components without variance beyond rounding have the root 0."""
    e, v = np.linalg.eigh(m.scatter / m.n)
    e, v = e[::-1], v[:, ::-1]
    trace, k = float(np.trace(m.scatter)) / m.n, min(components, len(e))
    sound = e > max(float(e[0]), 0.0) * len(e) * np.finfo(np.float64).eps
    root = np.sqrt(np.where(sound, e, 0.0))[:k]
    return Model(m.n, m.total, v[:, :k], root, np.where(sound, e, 0.0)[:k] / trace if trace > 0 else np.zeros(k))


def projected(x: np.ndarray, model: Model) -> np.ndarray:
    """Whitened values, a column for each component; NaN for components without variance."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(model.root > 0, centred(x, model.total, model.n) @ model.axes / model.root, np.nan)


def rounded_down(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose vector isn't null, isn't empty and holds finite numbers only."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c"))
    sound = (F.size("c") > 0) & F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.coalesce(sound, F.lit(False))).select("vec_id", F.transform("c", lambda c: F.floor(c * float(SCALE)).cast("long")).alias("x"))


def whiten(vectors: DataFrame, spark: SparkSession, components: int = COMPONENTS) -> DataFrame:
    """One row per sound row of ``vectors(vec_id, embedding)`` and component up to ``components``: the columns of OUT.

    Rows whose vector is null or empty, or holds a null or a number that isn't finite, are dropped. Vectors of each length
    are fitted and whitened on their own, with their own n and identity_error; a length below ``components``
    has as many components as entries. Each distinct vector of integers counts once in the fit, whatever the number of its copies; all
    rows come back, also those that repeat a vec_id; a null vec_id stays null. A component without
    variance (fewer distinct vectors than dimensions, a constant column) has a null whitened value and explained 0, and
    takes no part in identity_error, which is 0 if no component has variance. Integers beyond 64 bits become the nearest end of that range.
    ``deviation`` is exact up to 38 digits and null beyond. An empty table gives an empty result; other columns are not read.
    """
    rows = rounded_down(vectors)
    # equal vectors meet after each task has kept one of each, so a hot vector is a row a task at most
    fit = materialize(rows.select("x").distinct(), spark)
    models = {dim: fitted(m, components) for dim, m in gathered(fit, lambda _, x: moments(x)).items()}
    second = gathered(fit, lambda dim, x: whitened_moments(projected(x, models[dim])[:, models[dim].root > 0]))
    errors = {dim: float(np.abs(m.scatter / m.n - np.eye(len(m.total))).max(initial=0.0)) for dim, m in second.items()}
    names = [c.split()[0] for c in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, at in by_length(b.column("x")):
                part, model = b.take(pa.array(at)), models[dim]
                x, k, n = matrix(part.column("x")), len(model.root), len(at)
                each = pa.array(np.repeat(np.arange(n), k))
                y = projected(x, model).ravel()
                columns = [part.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model.n, dtype=np.int64)), deviations(x, model).take(each)]
                columns += [pa.array(y, pa.float64(), mask=np.isnan(y)), pa.array(np.tile(model.explained, n)), pa.array(np.full(n * k, errors[dim]))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, OUT)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` as a long, null where it has more than 63 bits."""
    return whiten(table(spark, sf_dir, "embeddings"), spark).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))
