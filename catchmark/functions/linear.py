"""Small symmetric positive definite systems as Column expressions, solved on result rows in the JVM.

A matrix of n rows is an array with the lower triangle row by row, a vector an array of n. The Cholesky factor is built element by element
by folding over the triangle; a pivot that is lost in rounding makes the whole factor NULL, and with it every solution.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least share of a diagonal element that must be left of it as a pivot.
PIVOT = 1e-13


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def _start(row) -> Column:
    """Place (from 1) of a row's first element in the triangle."""
    return (row * (row + 1) / 2).cast("int") + 1


def cholesky(matrix: Column, n: int) -> Column:
    """The lower triangle of the factor, or NULL where the matrix is not positive definite."""
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(i * (i + 1) // 2 + j).alias("at")) for i in range(n) for j in range(i + 1)])

    def step(done, p):
        i, j = p["i"], p["j"]
        known = _dot(F.slice(done, _start(i), j), F.slice(done, _start(j), j))
        left = F.get(matrix, p["at"]) - known
        pivot = F.when(left > F.get(matrix, p["at"]) * PIVOT, F.sqrt(F.greatest(left, F.lit(0.0))))
        return F.concat(done, F.array(F.when(i == j, pivot).otherwise(left / F.get(done, _start(j) + j - 1))))

    full = F.aggregate(places, F.array().cast("array<double>"), step)
    return F.when(F.forall(full, lambda v: v.isNotNull() & ~F.isnan(v)), full)


def forward(factor: Column, b: Column, n: int) -> Column:
    """z with factor z = b."""
    return F.aggregate(
        F.array(*map(F.lit, range(n))),
        F.array().cast("array<double>"),
        lambda z, i: F.concat(z, F.array((F.get(b, i) - _dot(F.slice(factor, _start(i), i), z)) / F.get(factor, _start(i) + i - 1))),
    )


def backward(factor: Column, z: Column, n: int) -> Column:
    """x with factor' x = z."""

    def step(x, i):
        below = F.array(*[F.when(F.lit(k) > i, F.get(factor, F.lit(k * (k + 1) // 2) + i)).otherwise(0.0) for k in range(n)])
        known = _dot(F.slice(below, i + 2, F.lit(n - 1) - i), x)
        return F.concat(F.array((F.get(z, i) - known) / F.get(factor, _start(i) + i - 1)), x)

    return F.aggregate(F.array(*map(F.lit, range(n - 1, -1, -1))), F.array().cast("array<double>"), step)


def inverse_diagonal(factor: Column, n: int) -> Column:
    """The diagonal of the inverse of the matrix that has this factor."""
    unit = lambda j: F.array(*[F.lit(1.0 if i == j else 0.0) for i in range(n)])
    size = lambda z: _dot(z, z)
    return F.array(*[size(forward(factor, unit(j), n)) for j in range(n)])
