"""Table-cell formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, digits: int) -> Column:
    """Fixed decimals, rounded on the number's exact binary value; an exact tie goes to the even digit.

    Java's formatter rounds the printed decimal instead, so the rounding is done here: ``err`` is the exact
    error of ``scaled``, which tells on which side of a seeming tie the number lies.
    """
    scale = float(10**digits)
    a = F.abs(x)
    scaled = a * scale
    split = a * 134217729.0  # 2**27 + 1: high and low halves multiply by the scale without rounding
    high = split - (split - a)
    err = (high * scale - scaled) + (a - high) * scale
    whole = F.floor(scaled)
    rest = scaled - whole
    up = (rest > 0.5) | ((rest == 0.5) & ((err > 0) | ((err == 0) & (whole % 2 == 1))))
    value = (whole + F.when(up, 1).otherwise(0)).cast("double") / scale * F.when(x < 0, -1.0).otherwise(1.0)
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", value))


def fmt_num(x: Column, digits: int = 2) -> Column:
    """'' for NULL; thousands separators and no decimals from 1000 up; else fixed decimals."""
    return F.when(x.isNull(), "").when(F.abs(x) >= 1000, F.format_number(x, 0)).otherwise(fixed(x, digits))


def short_repr(x: Column) -> Column:
    """Shortest decimal text of a double with a two-digit lower-case exponent, e.g. 1.2e-05."""
    s = F.regexp_replace(x.cast("string"), r"\.0E", "E")
    s = F.regexp_replace(s, r"E(-?)(\d)$", "e$10$2")
    return F.regexp_replace(s, "E", "e")


def fmt_p(p: Column) -> Column:
    """P-value cell. Text in exponent form or starting with '<' is passed through unchanged.

    ``short_repr`` already prints numbers below 1e-4 in exponent form, as the tables do; a plain
    zero is what reaches the '<1e-4' branch.
    """
    v = p.try_cast("double")
    # doubles under 1e-3 print with an exponent in Spark but only under 1e-4 in the tables
    s = F.when(v.isNotNull() & (F.abs(v) >= 1e-4), F.format_string("%.10f", v)).when(v == 0, "0.0").otherwise(
        short_repr(p)
    )
    return (
        F.when(p.isNull(), "")
        .when(s.startswith("<") | F.lower(s).contains("e-"), s)
        .when(v < 1e-4, "<1e-4")
        .when(v < 0.001, "<0.001")
        .when(v.isNotNull(), fixed(v, 3))
        .otherwise(s)
    )


def fmt_median_iqr(med: Column, q1: Column, q3: Column, digits: int = 3) -> Column:
    return F.when(med.isNull(), "").otherwise(
        F.concat(fixed(med, digits), F.lit(" ["), fixed(q1, digits), F.lit(", "), fixed(q3, digits), F.lit("]"))
    )


def fmt_range(low: Column, high: Column, digits: int = 2) -> Column:
    return F.concat(fmt_num(low, digits), F.lit("–"), fmt_num(high, digits))
