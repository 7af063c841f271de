"""Scalar cleaning, flags, labels and classes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINEL_ID = -9999
EXCLUDED_REGIONS = ("19", "20", "21", "22")


def to_number(c: Column) -> Column:
    """Double or NULL: unparsable text and NaN both become NULL."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def to_id(c: Column) -> Column:
    """Whole-number id or NULL; ids written as '12.0' are accepted."""
    return to_number(c).try_cast("bigint")


def finite(c: Column) -> Column:
    """True for numbers that are neither NULL, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def keep_values(df: DataFrame, value: str, min_value: float | None = 0.0, strict: bool = False) -> DataFrame:
    """Rows usable in a distribution: finite, and at or (strict) above ``min_value``; None keeps all non-null."""
    c = F.col(value)
    if min_value is None:
        return df.filter(c.isNotNull() & ~F.isnan(c))
    return df.filter(finite(c) & ((c > min_value) if strict else (c >= min_value)))


def parent_key(pfaf: Column, levels: int = 2) -> Column:
    """Basin key two levels up: drop the last digits by floor division."""
    return F.floor(pfaf / F.lit(float(10**levels))).cast("bigint")


def zfill(c: Column, width: int) -> Column:
    """Left-pad with zeros without ever truncating (``lpad`` alone would)."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def valid_region(c: Column, excluded=EXCLUDED_REGIONS) -> Column:
    return ~c.isin(*excluded)


def safe_ratio(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den)


def any_flag(*flags: Column) -> Column:
    return F.when(F.greatest(*flags) == 1, 1).otherwise(0)


def two_way_group(any_infra: Column) -> Column:
    return F.when(any_infra == 0, "None").otherwise("Infrastructure")


def exclusive_group(ai: Column, power: Column, tri: Column) -> Column:
    """One label per basin; the first sector present in the order AI, Power, TRI wins."""
    return F.when(ai == 1, "AI").when(power == 1, "Power").when(tri == 1, "TRI").otherwise("None")


def nearest_kind(distances: dict[str, Column]) -> Column:
    """Name of the smallest distance; on a tie the kind listed first wins, and NULLs never win."""
    least = F.least(*distances.values()) if len(distances) > 1 else next(iter(distances.values()))
    label = F.lit(None).cast("string")
    for kind, dist in reversed(list(distances.items())):
        label = F.when(dist == least, kind).otherwise(label)
    return label


def tertile(value: Column, t1: Column, t2: Column, labels=("low", "medium", "high")) -> Column:
    return F.when(value <= t1, labels[0]).when(value <= t2, labels[1]).when(value.isNotNull(), labels[2])


def quartile(value: Column, q1: Column, q2: Column, q3: Column) -> Column:
    return F.when(value <= q1, "Q1").when(value <= q2, "Q2").when(value <= q3, "Q3").when(value.isNotNull(), "Q4")


# Right-closed upper edges and labels of the percent classes.
PERCENT_CLASSES = (
    (0.000001, "0%"),
    (1.0, "0–1%"),
    (3.0, "1–3%"),
    (6.0, "3–6%"),
    (10.0, "6–10%"),
    (100.0, ">10%"),
)


def percent_class(pct: Column) -> Column:
    """Right-closed percent class; values outside 0..100 are the text ``nan``."""
    outside = pct.isNull() | (pct < 0) | (pct > PERCENT_CLASSES[-1][0])
    label = F.when(outside, "nan")
    for upper, name in PERCENT_CLASSES:
        label = label.when(pct <= upper, name)
    return label


def effect_word(v: Column) -> Column:
    return (
        F.when(v < 0.10, "very small").when(v < 0.30, "small").when(v < 0.50, "moderate").when(v.isNotNull(), "large")
    )


def significant(p: Column, level: float = 0.05) -> Column:
    return p < level
