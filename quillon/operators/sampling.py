"""Samples and cohorts that hang on hashes of ids, never on a random generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T


def stable_sample(questions: DataFrame, size: int, salt: str, split: str = "dev") -> DataFrame:
    """The ``size`` rows of a split with the smallest salted hash of their id, ranked from 1: a limit is the feature."""
    key = F.sha2(F.concat(F.lit(salt + "\n"), F.col("query_id")), 256)
    rows = questions.where(F.lower("split") == split).withColumn("selection_key", key)
    top = rows.orderBy("selection_key", "source_row", "query_id").limit(size)
    order = Window.partitionBy(F.lit(1)).orderBy("selection_key", "source_row", "query_id")  # at most ``size`` rows
    return top.withColumn("selection_rank", F.row_number().over(order))


def ordered_hash(df: DataFrame, order: str, *columns: str) -> DataFrame:
    """One row: SHA-256 over the rows' ids and hashes of contents, in order."""
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in columns])
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return df.agg(F.sha2(F.array_join(F.transform(rows, lambda x: x["line"]), "\n"), 256).alias("sha256"), F.count(F.lit(1)).alias("n_rows"))


def set_hash(df: DataFrame, column: str) -> DataFrame:
    """One row: SHA-256 over the sorted distinct values."""
    return df.agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.col(column).cast("string"))), "\n"), 256).alias("sha256"))


def prompt_winner(cells: DataFrame) -> DataFrame:
    """The prompt with the highest mean accuracy of ``cells(prompt_name, prompt, accuracy)``; ties go to fewer UTF-8 bytes, then the name."""
    mean = cells.groupBy("prompt_name", "prompt").agg(F.avg("accuracy").alias("mean_accuracy"), F.count(F.lit(1)).alias("n_cells"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("mean_accuracy"), F.octet_length("prompt"), "prompt_name")  # a row a prompt
    return mean.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def cohort_faults(prior: DataFrame, expected: DataFrame, key: str, hashes: list[str]) -> DataFrame:
    """(problem, n): prior rows outside the cohort, repeated keys, and rows whose hash columns differ from those expected."""
    outside = prior.join(expected, key, "left_anti").agg(F.lit("outside").alias("problem"), F.count(F.lit(1)).alias("n"))
    repeated = prior.groupBy(key).count().where("count > 1").agg(F.lit("repeated").alias("problem"), F.count(F.lit(1)).alias("n"))
    differ = F.lit(False)
    for h in hashes:
        differ = differ | ~F.col(f"a.{h}").eqNullSafe(F.col(f"b.{h}"))
    changed = prior.alias("a").join(expected.alias("b"), key).where(differ).agg(F.lit("changed").alias("problem"), F.count(F.lit(1)).alias("n"))
    return outside.union(repeated).union(changed)


def context_sha(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("retrieval_context_sha256", T.sha256(F.col(column)))
