"""Embedding near-dedup by iterative quantisation (operator 3).

A bounded sample of unit vectors of each length gives a centring, principal axes and rotations that are learned in
turns with the binary codes they balance (signs of the rotated axes). Every vector gets a code. The code is
cut into substrings, one hash table each; vectors that agree in a substring are candidates. Substrings are as long as the
logarithm of the number of vectors, so that buckets don't grow with it, and there are as many (from
further rotations) as it takes to find pairs at the threshold, which is tried out on the
sample. Candidates whose whole codes are near are reranked by the cosine of the original vectors in double precision.

Vectors that are equal bit for bit form a class with a count, so a group of copies is one row in
the tables; links between the members of a class follow from the count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import components, materialize, table

#: About so many vectors, over all lengths, are learned from, chosen by a hash of their id.
SAMPLE = 5_000
COSINE = 0.93
#: Share of pairs at the threshold that the tables must find on the sample, and the most tables for it.
RECALL = 0.985
TABLES = 64
#: Bits of one rotation.
BITS = 64


def rotation(x: np.ndarray, seed: int, rounds: int = 25) -> np.ndarray:
    """Projection (dimension x bits) of centred rows by iterative quantisation; as many bits as dimensions, BITS at most."""
    rng = np.random.default_rng(seed)
    if len(x) >= 4 * min(BITS, x.shape[1]):
        axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, : min(BITS, x.shape[1])]
    else:  # too few rows for axes
        axes = np.linalg.qr(rng.standard_normal((x.shape[1],) * 2))[0][:, : min(BITS, x.shape[1])]
    v, r = x @ axes, np.linalg.qr(rng.standard_normal((axes.shape[1],) * 2))[0]
    for _ in range(rounds if len(x) >= 4 * axes.shape[1] else 0):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return axes @ r


def pairs_at(x: np.ndarray, cosine: float, rng: np.random.Generator, n: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of ``x`` and others at exactly that cosine from them: half moved in any direction, half towards other rows."""
    a = x[rng.integers(0, len(x), n)]
    other = np.where(np.arange(n)[:, None] % 2 == 0, rng.standard_normal(a.shape), x[rng.integers(0, len(x), n)] + 1e-6 * rng.standard_normal(a.shape))
    other -= (other * a).sum(axis=1, keepdims=True) * a
    length = np.linalg.norm(other, axis=1, keepdims=True)
    return a, cosine * a + math.sqrt(1 - cosine * cosine) * other / np.where(length > 0, length, 1.0)


def learn(x: np.ndarray, n: int, cosine: float = COSINE, seed: int = 3) -> dict:
    """Mean, projection, width and number of tables, and the most bits in which candidates may differ, for ``n`` vectors like the unit rows ``x``."""
    rng = np.random.default_rng(seed)
    mean = x.mean(axis=0) if len(x) >= 4 * min(BITS, x.shape[1]) else np.zeros(x.shape[1])
    a, b = pairs_at(x, cosine, rng)
    projections, same, width = [], [], max(1, min(40, math.ceil(math.log2(max(2, n)))))
    while True:
        found = np.zeros(len(a), dtype=bool)
        for t in range(TABLES):
            while sum(p.shape[1] for p in projections) < (t + 1) * width:
                p = rotation(x - mean, seed + len(projections))
                projections.append(p)
                same.append(((a - mean) @ p >= 0) == ((b - mean) @ p >= 0))
            equal = np.concatenate(same, axis=1)
            found |= equal[:, t * width : (t + 1) * width].all(axis=1)
            if min(found[0::2].mean(), found[1::2].mean()) >= RECALL or width == 1 and t == 7:
                near = np.quantile((~equal[:, : (t + 1) * width]).sum(axis=1), 0.9995) + 1
                return {"mean": mean, "projection": np.concatenate(projections, axis=1)[:, : (t + 1) * width], "width": width, "tables": t + 1, "near": int(near)}
        width = max(1, width - 2)  # wider buckets find what the tables missed


def matrix(lists: pa.Array) -> np.ndarray:
    """The rows of a list array whose lists have one length."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def by_length(lists: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places) of the lists of each length."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    for k in np.unique(n):
        yield int(k), np.flatnonzero(n == k)


def coded(vectors: DataFrame, models: dict[int, dict], spark: SparkSession) -> DataFrame:
    """(rep, label, dim, near, code, keys): keys has one number for each table, code all bits."""
    shared = spark.sparkContext.broadcast(models)
    words = max(-(-m["projection"].shape[1] // 64) for m in models.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, at in by_length(b.column("embedding")):
                if dim not in shared.value:
                    continue
                part, m = b.take(pa.array(at)), shared.value[dim]
                v = matrix(part.column("embedding"))
                bits = (unit(v) - m["mean"]) @ m["projection"] >= 0
                tables = bits.reshape(len(v), m["tables"], m["width"])
                keys = tables @ (np.int64(1) << np.arange(m["width"], dtype=np.int64)) + (np.arange(m["tables"], dtype=np.int64) << 48)
                code = np.packbits(bits, axis=1)
                code = np.pad(code, ((0, 0), (0, 8 * words - code.shape[1]))).view(np.int64)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("label"), pa.array(np.full(len(v), dim, dtype=np.int32)), pa.array(np.full(len(v), m["near"], dtype=np.int32)), lists(code), lists(keys)], ["rep", "label", "dim", "near", "code", "keys"])

    return vectors.select("rep", "label", "embedding").mapInArrow(run, "rep long, label int, dim int, near int, code array<long>, keys array<long>")


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest number first, so that no square is beyond what a double holds."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def rerank(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(len(b), dtype=bool)
            for _, at in by_length(b.column("va")):
                u, v = (matrix(b.column(c).take(pa.array(at))) for c in ("va", "vb"))
                u, v = (x / np.abs(x).max(axis=1, keepdims=True) for x in (u, v))
                keep[at] = (u * v).sum(axis=1) / (np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1)) >= cosine
            yield b.filter(pa.array(keep)).select(["a", "b", "sa", "sb"])

    return run


def sample_of(classes: DataFrame, sample: int) -> dict[int, tuple[int, np.ndarray]]:
    """For each length the number of classes of the largest label, and the vectors to learn from as unit rows."""
    counts = classes.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("n"), F.sum("count").alias("all")).collect()  # a row for each length
    if not counts:
        return {}
    most = max(64, sample // len(counts))
    share = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["dim"], min(1.0, most / r["all"]))]), F.col("dim"))
    chosen = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < share * float(1 << 20)).select("dim", "embedding").toPandas()
    found = {dim: unit(np.stack(g["embedding"].to_numpy()).astype(np.float64)) for dim, g in chosen.groupby("dim")}
    return {r["dim"]: (r["n"], found.get(r["dim"], np.eye(1, r["dim"]))) for r in counts}


def near_duplicates(vectors: DataFrame, spark: SparkSession, cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, label)``: vec_id, n_links, component_id, kept.

    Links need equal labels that aren't null and vectors of one length; each length is indexed on its own. A vector that
    is null, empty or zero, or that holds a null or a number that isn't finite, links with nothing. Rows with a
    null vec_id link with nothing and get a null component. Rows that repeat a vec_id with the same vector and
    label are one vector; with others they are vectors of their own that share the id's result. An empty table gives an
    empty result; other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("int").alias("label"))
    sound = (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    able = rows.where("sound").select("vec_id", "label", F.transform("embedding", lambda x: x + 0.0).alias("embedding")).distinct()
    able = able.withColumn("v", F.sha2(F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","), 256))
    members = materialize(able.select("vec_id", "label", "v"), spark)
    classes = able.groupBy("label", "v", F.size("embedding").alias("dim")).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("embedding").alias("embedding"))
    # a vec_id with several vectors is the least of several classes: the number tells them apart
    classes = materialize(classes, spark)
    models = {dim: learn(x, n, cosine) for dim, (n, x) in sample_of(classes, sample).items()}
    if not models:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    codes = materialize(coded(classes, models, spark), spark)

    words = max(-(-m["projection"].shape[1] // 64) for m in models.values())
    stored = codes.select("rep", "label", "dim", "near", "code", F.explode("keys").alias("key"))
    differ = sum((F.bit_count(F.col("a.code")[i].bitwiseXOR(F.col("b.code")[i])) for i in range(words)), F.lit(0))
    on = (F.col("a.label") == F.col("b.label")) & (F.col("a.dim") == F.col("b.dim")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") < F.col("b.rep")) & (differ <= F.col("a.near"))
    found = stored.alias("a").join(stored.alias("b"), on).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), F.col("a.label").alias("label"), F.col("a.dim").alias("dim")).distinct()

    side = lambda k: classes.select(F.col("rep").alias(k), "label", "dim", F.col("embedding").alias(f"v{k}"), F.col("size").alias(f"s{k}"))
    both = found.join(side("a"), ["a", "label", "dim"]).join(side("b"), ["b", "label", "dim"])
    links = materialize(both.select("a", "b", "sa", "sb", "va", "vb").mapInArrow(rerank(cosine), "a long, b long, sa long, sb long"), spark)
    ends = links.select(F.col("a").alias("rep"), F.col("sb").alias("n")).union(links.select(F.col("b").alias("rep"), F.col("sa").alias("n")))
    counts = ends.groupBy("rep").agg(F.sum("n").alias("others"))
    parts = components(links, spark)
    of_class = classes.select("rep", "label", "v", "size").join(counts, "rep", "left").join(parts.select(F.col("id").alias("rep"), "component"), "rep", "left")
    of_class = of_class.select("label", "v", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    of_class = materialize(of_class.where("links > 0"), spark)
    linked = members.join(of_class, ["label", "v"]).groupBy("vec_id").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    out = rows.select("vec_id").join(linked, "vec_id", "left")
    part = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), part.alias("component_id"), F.col("vec_id").eqNullSafe(part).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), spark)
