"""Paired comparison of two arms over the same questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.stats import sign_test
from quillon.operators.checks import require
from quillon.operators.metrics import count_if


def paired(long: DataFrame, a: str, b: str, value: str, *keys: str) -> DataFrame:
    """(keys, query_id, a, b) from rows of (query_id, arm, value): one shuffle, no self-join."""
    side = lambda arm: F.max(F.when(F.col("arm") == arm, F.col(value)))
    both = long.where(F.col("arm").isin(a, b)).groupBy(*keys, "query_id").agg(side(a).alias("a"), side(b).alias("b"), F.countDistinct("arm").alias("_n"))
    return both.where("_n = 2").drop("_n")


def require_whole(long: DataFrame, a: str, b: str, *keys: str) -> None:
    """Raises unless both arms have the same questions."""
    both = long.where(F.col("arm").isin(a, b)).groupBy(*keys, "query_id").agg(F.countDistinct("arm").alias("arms"))
    require(both.where("arms < 2").agg(F.lit("paired_keys").alias("check"), F.count(F.lit(1)).alias("n_violations")))


def means(pairs: DataFrame, *keys: str) -> DataFrame:
    """Means of both arms, booleans as 0 and 1, and their difference."""
    a, b = (F.col(x).cast("double") for x in "ab")
    return pairs.select(*keys, a.alias("a"), b.alias("b")).groupBy(*keys).agg(F.avg("a").alias("a_mean"), F.avg("b").alias("b_mean"), F.avg(F.col("a") - F.col("b")).alias("difference"))


def histograms(pairs: DataFrame, *keys: str) -> DataFrame:
    """How often each arm has each score 1..5."""
    return pairs.groupBy(*keys).agg(*[count_if(F.col(x) == k).alias(f"{x}_score_{k}") for x in "ab" for k in range(1, 6)])


def contingency(pairs: DataFrame, *keys: str) -> DataFrame:
    """Of two booleans: both, only one, neither, and the exact sign test of the discordant pairs."""
    a, b = F.col("a"), F.col("b")
    out = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), count_if(a & b).alias("both"), count_if(a & ~b).alias("a_only"), count_if(~a & b).alias("b_only"), count_if(~a & ~b).alias("neither"))
    return out.withColumn("p_value", sign_test(F.col("a_only"), F.col("b_only")))


def deltas(pairs: DataFrame, *keys: str) -> DataFrame:
    """Of two scores 1..5: wins, losses and ties of a, mean of a - b, its histogram from -4 to 4, sign test."""
    d = F.col("a") - F.col("b")
    name = lambda k: f"delta_{'m' if k < 0 else 'p'}{abs(k)}"
    out = pairs.groupBy(*keys).agg(F.count(d).alias("n"), count_if(d > 0).alias("wins"), count_if(d < 0).alias("losses"), count_if(d == 0).alias("ties"), F.avg(d).alias("mean_delta"), *[count_if(d == k).alias(name(k)) for k in range(-4, 5)])
    return out.withColumn("p_value", sign_test(F.col("wins"), F.col("losses")))


def transitions(pairs: DataFrame, *keys: str) -> DataFrame:
    """Counts of all 25 pairs of scores 1..5 as columns from_i_to_j."""
    return pairs.groupBy(*keys).agg(*[count_if((F.col("a") == i) & (F.col("b") == j)).alias(f"from_{i}_to_{j}") for i in range(1, 6) for j in range(1, 6)])
