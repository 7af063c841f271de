"""Chi-square, Cramer's V and odds ratios on small tables of counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catchmark.functions.tails import chi2_sf
from catchmark.operators.ordered import require

Z95 = 1.96


def chi_square(counts: DataFrame, keys: Sequence[str], row: str, col: str, n: str = "n") -> DataFrame:
    """(keys, chi2, dof, p, n, cramers_v) of each r x c table given as long counts.

    With one degree of freedom the continuity correction applies; a zero expected cell is an error.
    """
    keys = list(keys)
    o = F.col(n).cast("double")
    total = lambda *by: F.sum(o).over(W.partitionBy(*(by or [F.lit(0)])))
    cells = counts.select(
        *keys, F.col(row).alias("_r"), F.col(col).alias("_c"), o.alias("_o"),
        total(*keys, row).alias("_rt"), total(*keys, col).alias("_ct"), total(*keys).alias("_t"),
    )
    cells = cells.withColumn("_e", F.col("_rt") * F.col("_ct") / F.col("_t"))
    cells = cells.filter(require(F.col("_e") > 0, "chi-square: an expected cell is zero"))
    gap = F.abs(F.col("_o") - F.col("_e"))
    trimmed = gap - F.least(F.lit(0.5), gap)
    out = cells.groupBy(*keys).agg(
        F.sum(gap * gap / F.col("_e")).alias("_plain"),
        F.sum(trimmed * trimmed / F.col("_e")).alias("_yates"),
        F.count_distinct("_r").alias("_nr"),
        F.count_distinct("_c").alias("_nc"),
        F.max("_t").alias("n"),
    )
    out = out.withColumn("dof", (F.col("_nr") - 1) * (F.col("_nc") - 1))
    out = out.withColumn("chi2", F.when(F.col("dof") == 1, F.col("_yates")).otherwise(F.col("_plain")))
    return out.select(
        *keys, "chi2", "dof", chi2_sf(F.col("chi2"), F.col("dof")).alias("p"), F.col("n").cast("bigint").alias("n"),
        cramers_v(F.col("chi2"), F.col("n"), F.col("_nr"), F.col("_nc")).alias("cramers_v"),
    )


def cramers_v(chi2: Column, n: Column, rows: Column, cols: Column) -> Column:
    den = n * F.least(rows - 1, cols - 1)
    return F.when(den > 0, F.sqrt(chi2 / den))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column, Column]:
    """(a/b)/(c/d) with a Wald 95% interval; 0.5 is added to all four cells if any is zero."""
    add = F.when(F.least(a, b, c, d) == 0, 0.5).otherwise(0.0)
    a, b, c, d = (x.cast("double") + add for x in (a, b, c, d))
    ratio = (a / b) / (c / d)
    half = F.sqrt(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d) * Z95
    return ratio, F.exp(F.log(ratio) - half), F.exp(F.log(ratio) + half)
