"""Language ID by multilingual mixture inference (operator 1).

The model is one distribution over hashed letter trigrams (bytes of the lower-cased UTF-8
text) for each language, counted over all learnable documents. A document is a mixture of languages:
expectation-maximisation estimates the proportions from the trigrams' likelihoods, and languages enter
the set in order of their proportion as long as the likelihood gained outweighs the
penalty for one more free proportion. The language with the largest proportion is the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import held_out, table

#: Trigrams are hashed to so many cells; the model holds this many counts for each language.
CELL_BITS = 16
#: Trigrams overlap threefold, so a document has a third as many independent ones.
OVERLAP = 3.0
UNKNOWN = "und"
_LETTERS = np.full(256, 32, dtype=np.uint32)
_LETTERS[128:] = np.arange(128, 256)
_LETTERS[97:123] = np.arange(97, 123)


def cells(text: str) -> np.ndarray:
    """The cell of each trigram of ``text``; ASCII characters that aren't letters count as space."""
    b = _LETTERS[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)]
    if len(b) < 3:
        return np.empty(0, dtype=np.int64)
    key = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    key = key[key != 0x202020]
    return ((key * np.uint32(2654435761)) >> np.uint32(32 - CELL_BITS)).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log likelihood of each cell (rows) in each language (columns).

    Counts cover all rows of ``docs(text, lang)`` with neither null. Each task sends the driver's
    aggregation one row per language and cell that it met; what is collected is the model itself.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                got = found.setdefault(lang, np.zeros(1 << CELL_BITS, dtype=np.int64))
                at, n = np.unique(cells(text.as_py()), return_counts=True)
                got[at] += n
        for lang, got in found.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(got[at], pa.int64())], ["lang", "cell", "n"])

    learnable = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    got = learnable.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    counts = np.zeros((1 << CELL_BITS, len(langs)))
    counts[got["cell"].to_numpy(dtype=np.int64), got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.float64)
    return langs, np.log((counts + 0.05) / (counts + 0.05).sum(axis=0, keepdims=True)) if langs else counts


def proportions(like: np.ndarray, n: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """EM over trigrams with likelihoods ``like`` (one column a language) and counts ``n``: shares, log likelihood."""
    share = np.full(like.shape[1], 1.0 / like.shape[1])
    for _ in range(rounds):
        joint = like * share
        new = ((n / joint.sum(axis=1)) @ joint) / n.sum()
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(n @ np.log((like * share).sum(axis=1)))


def infer(text: str, log_like: np.ndarray) -> list[tuple[int, float]]:
    """The languages of ``text`` as (column, share), the largest share first; empty if it has no letter."""
    if not log_like.shape[1] or not has_letter(text):
        return []
    at, n = np.unique(cells(text), return_counts=True)
    if not len(at):
        return []
    rows, n = log_like[at], n / OVERLAP
    like = np.exp(rows - rows.max(axis=1, keepdims=True)) + 1e-12
    share, _ = proportions(like, n)
    order = np.argsort(-share, kind="stable")
    best, kept = -np.inf, []
    penalty = 0.5 * np.log(n.sum() + 1.0) + 1.0
    for k in range(1, len(order) + 1):
        some = order[:k]
        share, gained = proportions(like[:, some], n) if k > 1 else (np.ones(1), float(n @ np.log(like[:, some[0]])))
        if gained - penalty * (k - 1) <= best:
            break
        best, kept = gained - penalty * (k - 1), sorted(zip(some.tolist(), share.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    return kept


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], spark: SparkSession) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, mixture.

    score is the share of lang_pred; mixture has every language of the chosen set. A null text and
    one without a letter are ``und`` with score 0 and an empty mixture; so is every text if nothing
    could be learned. Equal texts get equal results, rows that repeat stay apart, other columns are not read,
    and an empty table gives an empty result.
    """
    shared = spark.sparkContext.broadcast(model)  # languages x 2^CELL_BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, log_like = shared.value
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for b in batches:
            got = [[(langs[i], s) for i, s in infer(t.as_py() or "", log_like)] for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([g[0][0] if g else UNKNOWN for g in got], pa.string()), pa.array([min(1.0, g[0][1]) if g else 0.0 for g in got], pa.float64()), pa.array([[{"lang": x, "share": s} for x, s in g] for g in got], kind)],
                ["doc_id", "held_out", "lang_pred", "score", "mixture"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs.where(~held_out(F.col("doc_id")))), spark)
