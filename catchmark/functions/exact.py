"""The exact side of a line on which a point lies, as a Column expression.

Doubles round, so the plain determinant may have the wrong sign for a point near a line, or be zero beside it. Here a bound of its error tells
when the sign is certain; only else the determinant is summed without error: differences and products are split into a rounded value and
what rounding lost (two-sum, and two-product by halves of 26 bits), and the parts are added to an expansion whose components do not
overlap, so the last nonzero one has the sign. Exact for coordinates whose products neither overflow nor underflow (sizes between 1e-140 and 1e140).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (3 + 16 u) u with the unit roundoff u = 2^-53 bounds the determinant's relative error.
CERTAIN = (3.0 + 16.0 * 2.0**-53) * 2.0**-53
SPLIT = float(2**27 + 1)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def two_sum(a: Column, b: Column) -> Column:
    """[rounded a + b, what rounding lost]"""

    def lost(s: Column) -> Column:
        part = s - a
        return F.array(s, (a - (s - part)) + (b - part))

    return bound(a + b, lost)


def two_product(a: Column, b: Column) -> Column:
    """[rounded a * b, what rounding lost]"""

    def halves(x: Column) -> Column:
        return bound(x * SPLIT, lambda c: bound(c - (c - x), lambda high: F.array(high, x - high)))

    def lost(p: Column) -> Column:
        return bound(F.array(halves(a), halves(b)), lambda h: F.array(p, h[0][1] * h[1][1] - (((p - h[0][0] * h[1][0]) - h[0][1] * h[1][0]) - h[0][0] * h[1][1])))

    return bound(a * b, lost)


def exact_sign(terms: Column) -> Column:
    """-1, 0 or 1: the sign of the exact sum of an array of doubles."""

    def grown(expansion: Column, term: Column) -> Column:
        start = F.struct(term.alias("carry"), F.array().cast("array<double>").alias("done"))
        step = lambda acc, e: bound(two_sum(acc["carry"], e), lambda s: F.struct(s[0].alias("carry"), F.concat(acc["done"], F.array(s[1])).alias("done")))
        return F.aggregate(expansion, start, step, lambda acc: F.concat(acc["done"], F.array(acc["carry"])))

    whole = F.aggregate(terms, F.array().cast("array<double>"), lambda acc, t: F.when(t == 0, acc).otherwise(grown(acc, t)))
    return F.coalesce(F.signum(F.try_element_at(F.filter(whole, lambda v: v != 0), F.lit(-1))), F.lit(0.0)).cast("int")


def side_of_line(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """1 if the point lies left of the line from (x1, y1) to (x2, y2), -1 if right, 0 if exactly on it."""

    def exact() -> Column:
        # (x2 - x1)(py - y1) - (px - x1)(y2 - y1), every difference as value and loss
        ends = F.array(two_sum(x2, -x1), two_sum(py, -y1), two_sum(px, -x1), two_sum(y2, -y1))

        def parts(d: Column) -> Column:
            plus = [two_product(d[0][i], d[1][j]) for i in range(2) for j in range(2)]
            minus = [two_product(-d[2][i], d[3][j]) for i in range(2) for j in range(2)]
            return exact_sign(F.flatten(F.array(*plus, *minus)))

        return bound(ends, parts)

    def decided(p: Column) -> Column:
        det = p[0] - p[1]
        return F.when(F.abs(det) > (F.abs(p[0]) + F.abs(p[1])) * CERTAIN, F.signum(det).cast("int")).otherwise(exact())

    return bound(F.array((x2 - x1) * (py - y1), (px - x1) * (y2 - y1)), decided)
