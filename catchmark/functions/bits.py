"""The bits of doubles as Column expressions, by exact scaling with powers of two."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catchmark.functions.exact import bound


def _times_power(a: Column, k: Column) -> Column:
    """a * 2^k in three factors, as 2^k alone may be out of range."""
    power = lambda n: F.pow(F.lit(2.0), n.cast("double"))
    return bound(F.floor(k / 3), lambda third: a * power(third) * power(third) * power(k - third * 2))


def double_bits(x: Column) -> Column:
    """The IEEE 754 bits of a finite double as a long; NULL for NULL, NaN and infinities."""
    top, implicit = float(1 << 53), 1 << 52

    def of_size(size: Column) -> Column:
        """The bits of a positive double; each step is worked out once."""
        scaled = lambda e: _times_power(size, F.lit(52) - e)
        # the logarithm may be off by one beside a power of two; no exponent is below that of the least normal number
        least = F.greatest(F.floor(F.log2(size)) - 1, F.lit(-1022))
        exponent = lambda at: F.when(scaled(at) < top, at).when(scaled(at + 1) < top, at + 1).otherwise(at + 2)
        joined = lambda e: bound(scaled(e).cast("bigint"), lambda m: F.when(m < implicit, m).otherwise(F.shiftleft((e + 1023).cast("bigint"), 52) + (m - implicit)))
        return bound(least, lambda at: bound(exponent(at), joined))

    def whole(v: Column) -> Column:
        sign = F.when((v < 0) | (v.cast("string") == "-0.0"), F.lit(-(1 << 63))).otherwise(F.lit(0).cast("bigint"))
        size = F.when(v == 0, F.lit(0).cast("bigint")).otherwise(bound(F.abs(v), of_size))
        return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), size.bitwiseOR(sign))

    return bound(x.cast("double"), whole)


def little_endian_hex(x: Column) -> Column:
    """The eight bytes of a double, least significant first, as 16 upper-case hex digits."""
    return bound(F.lpad(F.hex(double_bits(x)), 16, "0"), lambda digits: F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(8)]))


def low_bytes(x: Column) -> Column:
    """The number of the first two bytes of ``little_endian_hex``: 0 .. 65535, in the same order."""
    return bound(double_bits(x), lambda b: b.bitwiseAND(F.lit(255)) * 256 + F.shiftright(b, 8).bitwiseAND(F.lit(255)))
