"""Seeded noise that gives the same number on any engine and any partitioning.

Only 64-bit integer arithmetic is used, so a row's number depends on its id and the seed alone:
no generator state, no partition order, and a lost task recomputes the same rows.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2147483647
HALF = 1 << 30
SECOND = 1_000_003


def _fold(x: Column) -> Column:
    return ((x * x) % MODULUS * F.lit(69621).cast("bigint") + 12345) % MODULUS


def hash31(key: Column, seed) -> Column:
    """Integer noise in [0, MODULUS) of any non-negative 64-bit key.

    The low 30 bits are folded first, then the other bits and the seed are added and folded again: ids far apart do not
    repeat one another, and two seeds are not shifts of one sequence. Squaring folds ids together: order by (hash, id),
    never by hash alone.
    """
    key = key.cast("bigint")
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    low = _fold((F.pmod(key, F.lit(HALF).cast("bigint")) * 48271 + 11) % MODULUS)
    high = F.shiftright(key, 30) % MODULUS * 16807
    return _fold((low + high + F.pmod(seed.cast("bigint"), F.lit(MODULUS).cast("bigint")) * 40692) % MODULUS)


def hashed_uniform(key: Column, seed) -> Column:
    """Uniform in [0, 1] with the resolution of a double, from two numbers; 1 only by rounding."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return (hash31(key, seed) + hash31(key, seed + SECOND) / F.lit(float(MODULUS))) / F.lit(float(MODULUS))
