"""Exact dedup by skew-safe combining (operator 4): DataFrame functions only.

Rows are first combined inside each map task (Spark's partial aggregation), then
in groups of digest, full text and salt, then the winners of the salts globally. Every
stage groups by the whole normalised text, so texts that merely share a digest
never merge. A text that a third of all rows hold leaves at most one row per map
task and then one per salt.

Verdicts go back to the rows by digest where the groups have shown that all texts of the digest are equal; the
rows of any other digest are joined by their whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, boxed, materialize, table


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def digest_of(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), normalised(F.col("text")).alias("norm")).select("id", "norm", digest_of(F.col("norm")).alias("digest"))


def text_groups(docs: DataFrame, salts: int = 16) -> DataFrame:
    """(digest, norm, keep_id, group_size) of each distinct text, dealt by digest."""
    salted = keyed(docs).withColumn("salt", F.spark_partition_id() % salts)
    winners = salted.groupBy("digest", "norm", "salt").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    return winners.repartition("digest").groupBy("digest", "norm").agg(F.min("least").alias("keep_id"), F.sum("n").alias("group_size"))


def with_verdicts(rows: DataFrame, docs: DataFrame, salts: int) -> DataFrame:
    """``rows(norm, digest, ...)`` of ``docs`` with keep_id, null where the text is alone, and group_size."""
    spark = docs.sparkSession
    of_digest = text_groups(docs, salts).groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    of_digest = materialize(of_digest.where("texts > 1 OR group_size > 1"), spark)
    unlike = of_digest.where("texts > 1").select("digest")
    of_digest = of_digest.hint("merge")  # grows with the corpus: one plan at every size, never a broadcast
    if unlike.isEmpty():
        return rows.drop("norm").join(of_digest.drop("texts"), "digest", "left")
    apart = rows.join(unlike, "digest", "left_semi")
    of_text = text_groups(docs, salts).join(unlike, "digest", "left_semi").where("group_size > 1")
    apart = apart.join(of_text, ["digest", "norm"], "left").drop("norm")
    alike = rows.drop("norm").join(unlike, "digest", "left_anti").join(of_digest.where("texts = 1").drop("texts"), "digest", "left")
    return alike.unionByName(apart)


def verdict(id: Column) -> tuple[Column, Column, Column]:
    """keep_id, group_size and kept of a row of ``with_verdicts``."""
    keep = F.when(F.col("group_size").isNull(), id).otherwise(F.col("keep_id"))
    return keep, F.coalesce("group_size", F.lit(1)).cast("long"), id.eqNullSafe(keep)


def exact_dedup(docs: DataFrame, salts: int = 16) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are one text. Of equal texts the smallest doc_id stays;
    null ids stay only if the whole group has none. Rows that repeat both id and text
    are one document written twice: they count in group_size and share the verdict.
    An empty table gives an empty result. Other columns of ``docs`` are not read.
    Rows of a very common text meet in the last join only as ids and digests, which
    adaptive execution splits.
    """
    keep, size, kept = verdict(F.col("id"))
    out = with_verdicts(keyed(docs).withColumn("sha", F.sha2("norm", 256)), docs, salts)
    return out.select(F.col("id").alias("doc_id"), keep.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))


def keep_first(docs: DataFrame, salts: int = 16) -> DataFrame:
    """The rows of ``docs``, all columns, without the later copies of a text.

    Each row is judged on its own id and text: null or repeated ids of other texts aren't touched by it. Null
    ids go if a copy has an id, and stay if none has; rows that repeat id and text stay or go together. Null and
    empty texts are one text. Columns may have any other names; an empty table gives an empty result.
    """
    rows = boxed(docs, id=F.col("doc_id").cast("long"), norm=normalised(F.col("text")))
    rows = rows.withColumn("digest", digest_of(F.col("norm")))
    return with_verdicts(rows, docs, salts).where(verdict(F.col("id"))[2]).select("row.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
