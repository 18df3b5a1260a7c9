"""Exact statistics as column expressions of constant size, whatever the counts."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nodes of the quadrature, and the exponent beyond which its integrand counts for nothing.
NODES = 32
DECAY = 45.0
#: Below this a factorial's distance from Stirling's formula comes from a table, from here on from its series.
SMALL = 16


def _stirling_error(n: Column) -> Column:
    """ln n! - ((n + 1/2) ln n - n + ln(2 pi) / 2) of a double n >= 1."""
    table = F.array(*[F.lit(math.lgamma(k + 1) - ((k + 0.5) * math.log(k) - k + 0.5 * math.log(2 * math.pi))) for k in range(1, SMALL)])
    q = F.lit(1.0) / (n * n)
    series = (F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - (F.lit(1 / 1680) - q / 1188) * q) * q) * q) / n
    return F.when(n < SMALL, F.get(table, n.cast("int") - 1)).otherwise(series)


@functools.cache
def _nodes() -> list[tuple[float, float]]:
    """Places in (0, 1) and weights of Gauss and Legendre."""
    x, w = np.polynomial.legendre.leggauss(NODES)
    return [(float(a), float(b)) for a, b in zip((x + 1) / 2, w / 2, strict=True)]


def _log_lower(n: Column, k: Column) -> Column:
    """ln P(X <= k) for 1 <= k < n / 2, both doubles.

    The tail is (n - k) C(n, k) / 2^(n-1) times the integral over s from 0 to 1/2 of exp(k ln(1 - 4 s^2) + (n - 2k - 1) ln(1 - 2s)),
    the incomplete beta function with both terms of one sign, so nothing cancels. C(n, k) / 2^n comes from the deviance and Stirling's errors.
    """
    d = n - 2 * k
    e = d / n
    deviance = n / 2 * (F.log1p(-e * e) + e * (F.log1p(e) - F.log1p(-e)))
    point = 0.5 * F.log(n / (2 * math.pi * k * (n - k))) + _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - deviance
    slope = 2 * (d - 1)  # the exponent falls at least as fast as -slope s - 2 (n-1) s^2
    width = F.least(F.lit(0.5), (F.sqrt(slope * slope + 8 * DECAY * (n - 1)) - slope) / (4 * (n - 1)))
    nodes = F.array(*[F.struct(F.lit(2 * x).alias("x"), F.lit(w).alias("w")) for x, w in _nodes()])
    start = F.struct(F.lit(0.0).alias("total"), width.alias("width"), k.alias("k"), (d - 1).alias("d"))

    def add(acc: Column, node: Column) -> Column:
        s = node["x"] * acc["width"]
        total = acc["total"] + node["w"] * F.exp(acc["k"] * F.log1p(-s * s) + acc["d"] * F.log1p(-s))
        return F.struct(total.alias("total"), acc["width"].alias("width"), acc["k"].alias("k"), acc["d"].alias("d"))

    return point + F.log(2 * (n - k)) + F.aggregate(nodes, start, add, lambda acc: F.log(acc["total"] * acc["width"]))


def log_binomial_tail(n: Column, k: Column) -> Column:
    """ln of the sum of C(n, i) / 2^n for i from 0 to k: -infinity below 0, 0 from n on. No loop over k."""
    n, k = n.cast("double"), k.cast("double")
    near = 2 * k < n
    j = F.when(near, k).otherwise(n - k - 1)  # the tail above k is the one below this
    lower = F.when(j < 0, F.lit(float("-inf"))).when(j == 0, -n * math.log(2.0)).otherwise(_log_lower(n, j))
    return F.when(near, lower).otherwise(F.log1p(-F.exp(lower)))


def log_sign_test(wins: Column, losses: Column) -> Column:
    """ln of ``sign_test``, also where that is too small for a double."""
    n, k = wins + losses, F.least(wins, losses)
    return F.when(wins == losses, F.lit(0.0)).otherwise(F.least(F.lit(0.0), math.log(2.0) + log_binomial_tail(n, k)))


def sign_test(wins: Column, losses: Column) -> Column:
    """Exact two-sided sign test; 1.0 without a decided pair."""
    return F.exp(log_sign_test(wins, losses))
