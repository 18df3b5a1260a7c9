"""Numbers without a single task, and exact tails in constant memory."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quillon.functions import stats
from quillon.operators import assemble


def tail(n, k):
    return Fraction(sum(math.comb(n, i) for i in range(k + 1)), 2**n)


def test_binomial_tail_against_exact_fractions(spark):
    rng = random.Random(1)
    cases = [(n, k) for n in range(1, 22) for k in range(-1, n + 2)] + [(n, rng.randrange(n)) for n in (50, 333, 1200, 3000) for _ in range(12)] + [(2001, 1000), (2000, 999), (2000, 1000), (4000, 1), (2000, 0)]
    got = spark.createDataFrame([(n, k) for n, k in cases], "n long, k long").select("n", "k", stats.log_binomial_tail(F.col("n"), F.col("k")).alias("v")).collect()
    for r in got:
        exact = tail(r.n, min(r.k, r.n)) if r.k >= 0 else 0
        want = math.log(exact.numerator) - math.log(exact.denominator) if exact else float("-inf")
        assert r.v == want or abs(r.v - want) < 1e-11 * max(1, abs(want)), r


def test_sign_test_of_large_counts(spark):
    """At 10^9 and more decided pairs: equal counts are 1, near ones agree with the normal curve, far ones keep their logarithm."""
    def normal(w, l):  # two-sided, with the correction for continuity
        z = (abs(w - l) - 1) / math.sqrt(w + l)
        return math.erfc(z / math.sqrt(2))

    rows = [(10**9, 10**9), (10**9, 10**9 - 1), (10**9 + 30_000, 10**9 - 30_000), (10**9 + 90_000, 10**9 - 90_000), (10**9, 0), (2 * 10**9, 10**9), (10**15, 10**15 - 3 * 10**7)]
    got = spark.createDataFrame(rows, "w long, l long").select("w", "l", stats.sign_test(F.col("w"), F.col("l")).alias("p"), stats.log_sign_test(F.col("w"), F.col("l")).alias("ln")).collect()
    assert got[0].p == 1.0 and got[1].p == pytest.approx(1.0, abs=1e-9)
    for r in (got[2], got[3], got[6]):
        assert r.p == pytest.approx(normal(r.w, r.l), rel=1e-4)
    assert got[4].p == 0.0 and got[4].ln == pytest.approx(math.log(2) - 10**9 * math.log(2), rel=1e-14)
    n, k = 3 * 10**9, 10**9  # the tail's first term times a geometric series
    deviance = n * math.log(2) + k * math.log(k / n) + (n - k) * math.log((n - k) / n)
    assert got[5].p == 0.0 and got[5].ln == pytest.approx(-deviance, rel=1e-7)


def test_published_values(spark):
    rows = [(0, 0, 1.0), (5, 5, 1.0), (734, 450, 1.4097105e-16), (611, 343, 3.2680298e-18), (1, 0, 1.0), (6, 0, 2 / 64)]
    got = spark.createDataFrame(rows, "w long, l long, p double").select("p", stats.sign_test(F.col("w"), F.col("l")).alias("v")).collect()
    assert all(r.v == pytest.approx(r.p, rel=1e-7) for r in got)


def test_numbers_over_many_partitions(spark):
    """One group holds nearly all rows, many share a place; groups and places may be null."""
    rng = random.Random(2)
    rows = [(rng.choice(["a"] * 9 + ["b", None]), rng.choice([None, 7, 7, 7, *range(50)]), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, o int, id int").repartition(11)
    got = assemble.ordinals(df, "g", "o", "n").collect()
    assert sorted(r.id for r in got) == list(range(4000)) and got[0].asDict().keys() == {"g", "o", "id", "n"}
    for g in ("a", "b", None):
        mine = sorted((r.n, r.o is not None, r.o or 0) for r in got if r.g == g)
        assert [m[0] for m in mine] == list(range(len(mine))) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)
    assert assemble.ordinals(df.where("false"), "g", "o", "n").collect() == []


def test_no_task_holds_a_whole_table(spark):
    """10^7 rows of one group and one place: no partition of the sorted rows has more than a few times its share."""
    seen = []

    def keep(df):
        from quillon.sources import scratch

        out = scratch.kept(df)
        seen.append(out.groupBy("_part").count().agg(F.count(F.lit(1)), F.max("count")).first())
        return out

    df = spark.range(0, 10**7, 1, 16).select(F.lit("all").alias("g"), F.lit(1).alias("o"))
    got = assemble.ordinals(df, "g", "o", "n", keep).agg(F.count(F.lit(1)), F.min("n"), F.max("n"), F.sum("n")).first()
    assert tuple(got) == (10**7, 0, 10**7 - 1, 10**7 * (10**7 - 1) // 2)
    assert seen[0][0] == 4 and seen[0][1] < 2 * 10**7 / 4
