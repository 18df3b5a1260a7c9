"""Target-distribution importance resampling (operator 13).

Hashed n-gram counts of all documents and of the target texts give an array of gains, one for each bucket; a document's
weight is the sum of the gains of its features, and a keyed Gumbel number makes the highest scores a sample without replacement
by weight. Which documents are drawn is found by radix selection on the digits of (score, doc_id): each round counts
the rows of each value of one digit, keeps the value in which the k-th row lies, and writes the rows that still tie, so no
round sorts anything. Only the drawn rows are range-sorted; counts of the sorted partitions turn places into ranks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialize, table

BUCKETS = 10_000
#: Features are runs of one to so many words.
LONGEST = 1
#: Documents with fewer words aren't drawn; of the others this share is.
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Bits of a digit: a round counts at most 2**DIGIT values.
DIGIT = 16
#: A task remembers the buckets of so many features at a time.
MEMORY = 400_000

#: Bytes of words are digits, a-z and all beyond ASCII; A-Z become a-z, all others part words.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


class Buckets(dict):
    """Feature bytes to bucket, worked out where missing and forgotten when there are too many."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def featured(text: str | None, known: Buckets, longest: int) -> tuple[int, np.ndarray]:
    """Number of words and the buckets of all features, repeats counted."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()
    found = [known[w] for w in words]
    for n in range(2, longest + 1):
        found += [known[b" ".join(words[i : i + n])] for i in range(len(words) - n + 1)]
    return len(words), np.array(found, dtype=np.int64)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all rows of ``texts(text)`` in each bucket; every task adds up its own first, and the driver gets a number for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for text in b.column(0):
                total += np.bincount(featured(text.as_py(), known, longest)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray, scale: float = 1000.0) -> np.ndarray:
    """floor(scale * ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) for each bucket, in doubles."""
    s, t, n = raw.astype(np.float64), target.astype(np.float64), len(raw)
    return np.floor(scale * np.log((t + 1) * (raw.sum() + float(n)) / ((s + 1) * (target.sum() + float(n))))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight); ``row`` is a number of its own for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = Buckets(len(gain)), TaskContext.get().partitionId() << 40
        for b in batches:
            found = [(n, len(at), int(gain[at].sum())) for n, at in (featured(text.as_py(), known, longest) for text in b.column(1))]
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(b))), b.column(0), *columns], ["row", "doc_id", "n_words", "n_features", "weight"])
            row += len(b)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "row long, doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of the SHA-256 of ``seed:doc_id``; without an id of ``seed:``."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(u))).cast("long")


def _unsigned(c: str) -> Column:
    """A long whose bits, read without a sign, have the order of ``c``."""
    return F.col(c).bitwiseXOR(F.lit(-(1 << 63)))


def kth(rows: DataFrame, key: list[str], k: int, spark: SparkSession) -> list[int]:
    """Values of the first columns of ``key`` such that exactly ``k`` rows, of at least that many, are not above them.

    The order is that of the long columns ``key``, which hold no null and together tell all rows apart; fewer values than columns
    come back where they suffice. Digits that all open rows share are skipped.
    """
    bound, need = [], k
    for c in key:
        u = _unsigned(c)
        n, low, high = rows.agg(F.count(F.lit(1)), F.min(c), F.max(c)).first()
        if n == need:
            break
        low, high = low + (1 << 63), high + (1 << 63)
        while low != high:
            shift = max(0, (low ^ high).bit_length() - DIGIT)
            digit = F.shiftrightunsigned(u, shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
            counts = sorted(rows.groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("low"), F.max(c).alias("high")).collect())  # at most 2**DIGIT rows
            for r in counts:
                if need <= r["n"]:
                    break
                need -= r["n"]
            rows = materialize(rows.where(digit == r["digit"]), spark)
            low, high = r["low"] + (1 << 63), r["high"] + (1 << 63)
            if need == r["n"]:  # all that tie so far belong to the k: their greatest value is the bound
                return [*bound, high - (1 << 63)]
        bound.append(low - (1 << 63))
    return bound


def not_above(key: list[str], bound: list[int]) -> Column:
    """Whether the columns ``key`` come before ``bound`` in lexical order or equal it."""
    before, same = F.lit(False), F.lit(True)
    for c, v in zip(key, bound, strict=False):
        before, same = before | (same & (F.col(c) < F.lit(v))), same & (F.col(c) == F.lit(v))
    return before | same


def ranked(rows: DataFrame, key: list[str], spark: SparkSession) -> DataFrame:
    """``rows`` with ``rank`` from 1 in the order of ``key``: range partitions, places in each, and counts of those before (a row each)."""
    line = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    line = materialize(line.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), spark)
    before, start = [], 0
    for r in sorted(line.groupBy("part").count().collect()):
        before += [F.lit(r["part"]), F.lit(start)]
        start += r["count"]
    if not before:
        return line.select(*rows.columns, F.lit(None).cast("long").alias("rank"))
    return line.select(*rows.columns, (F.element_at(F.create_map(*before), F.col("part")) + F.col("place") + 1).cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, spark: SparkSession, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank (null: not drawn).

    Null and empty texts have no feature and weight 0; an empty target or table gives gains all the same. Rows without an id share one random
    number and come after those with an id in a tie. Rows that repeat a doc_id are drawn each on its own; those with equal
    score go by n_features, those equal in that too are alike, so it doesn't matter which of them has which rank. An
    empty table gives an empty result; other columns are not read.
    """
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    scored = weighed(docs, gain, longest).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = materialize(scored.withColumns({"down": -F.col("score"), "no_id": F.col("doc_id").isNull().cast("long"), "id": F.coalesce("doc_id", F.lit(0))}), spark)
    able, key, out = scored.where(F.col("n_words") >= least_words), ["down", "no_id", "id", "n_features", "row"], ["doc_id", "n_features", "weight", "score", "rank"]
    k = percent * able.count() // 100
    none = F.lit(None).cast("long")
    if not k:
        return scored.withColumn("rank", none).select(*out)
    drawn = (F.col("n_words") >= least_words) & not_above(key, kth(able, key, k, spark))
    return ranked(scored.where(drawn), key, spark).select(*out).unionByName(scored.where(~drawn).withColumn("rank", none).select(*out))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), spark)
