"""Tail probabilities as Column expressions (relative error below 1e-12).

Spark has no erf or gamma. The finite sums and the continued fraction are folded with ``aggregate`` over a
constant index array, so the expression stays small and runs in the JVM on the result rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SWITCH = 2.0


def _indices(n: int) -> Column:
    return F.sequence(F.lit(1), F.lit(n))


def erfc(z: Column) -> Column:
    """Complementary error function for any z."""
    a = F.abs(z)
    # erf(a) = 2/sqrt(pi) * exp(-a^2) * sum 2^k a^(2k+1) / (2k+1)!!  (all terms positive)
    start = F.struct(a.alias("term"), a.alias("total"))

    def step(acc, k):
        term = acc["term"] * (a * a * 2.0) / (k * 2.0 + 1.0)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(_indices(60), start, step, lambda acc: acc["total"])
    small = 1.0 - series * F.exp(-a * a) * (2.0 / math.sqrt(math.pi))
    # Laplace continued fraction, folded from the far end
    fraction = F.aggregate(F.reverse(_indices(80)), a, lambda acc, k: a + (k / 2.0) / acc)
    large = F.exp(-a * a) / (fraction * math.sqrt(math.pi))
    tail = F.when(a < _SWITCH, small).otherwise(large)
    return F.when(z >= 0, tail).otherwise(2.0 - tail)


def normal_two_sided(z: Column) -> Column:
    return erfc(F.abs(z) / math.sqrt(2.0))


def chi2_sf(x: Column, dof: Column) -> Column:
    """P(chi-square with ``dof`` degrees of freedom > x) by the exact finite sums for even and odd dof."""
    half = x / 2.0
    n_terms = F.floor(dof / 2).cast("int")
    is_even = dof % 2 == 0
    # even: terms h^k/k!, k = 0..n-1;  odd: terms h^(k+1/2)/Gamma(k+3/2), k = 0..n-1
    first = F.when(is_even, F.lit(1.0)).otherwise(F.sqrt(half) * (2.0 / math.sqrt(math.pi)))
    shift = F.when(is_even, F.lit(0.0)).otherwise(F.lit(0.5))
    start = F.struct(first.alias("term"), F.lit(0.0).alias("total"))

    def step(acc, k):
        return F.struct(
            (acc["term"] * half / (k + shift)).alias("term"),
            (acc["total"] + acc["term"]).alias("total"),
        )

    index = F.when(n_terms >= 1, F.sequence(F.lit(1), F.greatest(n_terms, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )
    total = F.aggregate(index, start, step, lambda acc: acc["total"])
    body = total * F.exp(-half)
    return F.when(is_even, body).otherwise(erfc(F.sqrt(half)) + body)


def kolmogorov_sf(lam: Column) -> Column:
    """Limit law of the two-sample KS statistic, P(K > lam)."""
    # the alternating series converges fast from 1 up; below it the theta-function dual does
    alternating = F.aggregate(
        _indices(100),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    dual = F.aggregate(
        _indices(100),
        F.lit(0.0),
        lambda acc, k: acc + F.exp(-((k * 2.0 - 1.0) * (k * 2.0 - 1.0)) * (math.pi**2) / (8.0 * lam * lam)),
    )
    value = F.when(lam < 1.0, 1.0 - dual * math.sqrt(2.0 * math.pi) / lam).otherwise(alternating)
    return F.when(lam <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
