"""Sinks. Tables are committed by Spark's protocol; only summaries of bounded size touch the driver."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillon.sources import scratch


class CheckFailed(ValueError):
    """A table that must not be used."""


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_checked(df: DataFrame, path: str, violations: dict[str, Column], rows: int | None = None, key: str | None = None) -> dict[str, int]:
    """Writes ``df`` if none of its rows violates a check, and raises otherwise; gives the counts.

    The counts are observed in the pass that works the rows out, into a table in the shared folder; only a sound one is copied to ``path``. ``rows`` is
    the number wanted; ``key`` must not be null and must not repeat, which needs a second pass over that column alone.
    """
    seen = Observation()
    metrics = [F.count(F.lit(1)).alias("rows"), *[F.count(F.when(c, F.lit(1))).alias(n) for n, c in violations.items()]]
    if key:
        metrics.append(F.count(F.when(F.col(key).isNull(), F.lit(1))).alias("null_key"))
    staged = scratch.kept(df.observe(seen, *metrics))
    found = dict(seen.get)
    bad = {n: v for n, v in found.items() if n != "rows" and v}
    if rows is not None and found["rows"] != rows:
        bad["rows"] = found["rows"]
    if key and (repeated := staged.groupBy(key).count().where("count > 1").count()):
        bad["repeated_key"] = repeated
    if bad:
        raise CheckFailed(", ".join(f"{n}: {v}" for n, v in bad.items()))
    write_table(staged, path)
    return found


def append_checkpoint(df: DataFrame, path: str, batch: int) -> None:
    """One more batch of a checkpoint; readers take the latest row of each key."""
    df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(path)


def write_summary(df: DataFrame, stem: str) -> None:
    """A small summary as CSV (nulls empty) and as indented JSON (nulls null, never NaN) side by side."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    rows = [{k: None if isinstance(v, float) and v != v else v for k, v in r.items()} for r in rows]
    Path(f"{stem}.json").write_text(json.dumps(rows, indent=2, ensure_ascii=False, default=str) + "\n")
    cell = lambda v: "" if v is None else '"' + str(v).replace('"', '""') + '"' if any(c in str(v) for c in ',"\n') else str(v)
    Path(f"{stem}.csv").write_text("\n".join([",".join(df.columns), *(",".join(cell(r[c]) for c in df.columns) for r in rows)]) + "\n")


def write_provenance(path: str, facts: dict) -> None:
    Path(path).write_text(json.dumps(facts, indent=2, ensure_ascii=False, sort_keys=True) + "\n")


def manifest_differences(spark: SparkSession, listed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem) where two listings (path, bytes, sha256) differ: missing, unlisted or changed."""
    j = listed.alias("a").join(found.alias("b"), "path", "full_outer")
    problem = F.when(F.col("b.sha256").isNull(), "missing").when(F.col("a.sha256").isNull(), "unlisted").when((F.col("a.sha256") != F.col("b.sha256")) | (F.col("a.bytes") != F.col("b.bytes")), "changed")
    return j.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def show(df: DataFrame, n: int = 50) -> None:
    df.show(n, truncate=False)
