"""Streamflow regime metrics from a long table (feature_id, time, q)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catchmark.functions.clean import safe_ratio

METRICS = ("meanQ", "stdQ", "CVQ", "Q10", "Q90", "RBI", "season_conc")


def flow_window(flow: DataFrame, start: str, end: str, reaches: DataFrame | None = None) -> DataFrame:
    """Rows of whole days start..end, optionally only of the given reaches (unknown reaches are ignored).

    The bounds are literals on ``time`` so that they reach the scan; a ``year`` partition column, if there is
    one, is bounded as well.
    """
    first, stop = F.lit(start).cast("date"), F.date_add(F.lit(end).cast("date"), 1)
    out = flow.filter((F.col("time") >= first.cast("timestamp")) & (F.col("time") < stop.cast("timestamp")))
    if "year" in flow.columns:
        out = out.filter(F.col("year").between(int(start[:4]), int(end[:4])))
    if reaches is not None:
        out = out.join(reaches.select("feature_id").distinct(), "feature_id", "left_semi")
    return out


def flow_column(df: DataFrame) -> DataFrame:
    """Name the flow column q: ``streamflow`` when present, else ``q``."""
    for name in ("streamflow", "q"):
        if name in df.columns:
            return df.withColumnRenamed(name, "q")
    raise ValueError(f"no streamflow or q among {df.columns}")


def daily_mean(flow: DataFrame) -> DataFrame:
    """(feature_id, day, q): mean of a calendar day's readings; days without a reading have no row."""
    rows = flow.filter(F.col("q").isNotNull() & ~F.isnan("q"))
    return rows.groupBy("feature_id", F.to_date("time").alias("day")).agg(F.avg("q").alias("q"))


def regime_metrics(daily: DataFrame, months: int = 12) -> DataFrame:
    """The seven metrics of each reach from its daily means.

    One shuffle by reach serves everything: the lag window and the aggregate share it, monthly means are
    conditional sums. A reach has at most one row per day, so no reach can grow without bound.

    - std is the population form; Q10/Q90 interpolate linearly
    - RBI sums absolute day-to-day changes only where the previous calendar day exists
    - season_conc adds the three largest monthly means; with fewer than ``months`` months of data the missing
      ones sort last and use up slots, so they are taken off the three
    """
    w = W.partitionBy("feature_id").orderBy("day")
    prev_ok = F.lag("day").over(w) == F.date_sub("day", 1)
    steps = daily.withColumn("dq", F.when(prev_ok, F.abs(F.col("q") - F.lag("q").over(w)))).withColumn("m", F.month("day"))
    in_month = [F.when(F.col("m") == k, F.col("q")) for k in range(1, 13)]
    agg = steps.groupBy("feature_id").agg(
        F.avg("q").alias("meanQ"),
        F.stddev_pop("q").alias("stdQ"),
        F.percentile("q", [0.1, 0.9]).alias("_p"),
        F.coalesce(F.sum("dq"), F.lit(0.0)).alias("_change"),
        F.sum("q").alias("_sum"),
        F.array_compact(F.array(*[F.avg(c) for c in in_month])).alias("_clim"),
    )
    slots = F.lit(3) - (F.lit(months) - F.size("_clim"))
    top = F.slice(F.sort_array("_clim", asc=False), F.lit(1), F.greatest(F.least(slots, F.lit(3)), F.lit(0)))

    def total(a):
        return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)

    return agg.select(
        "feature_id",
        "meanQ",
        "stdQ",
        safe_ratio(F.col("stdQ"), F.col("meanQ")).alias("CVQ"),
        F.col("_p")[0].alias("Q10"),
        F.col("_p")[1].alias("Q90"),
        safe_ratio(F.col("_change"), F.col("_sum")).alias("RBI"),
        safe_ratio(total(top), total(F.col("_clim"))).alias("season_conc"),
    )


def top_reaches(reach_map: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` reaches of highest order per basin; unknown orders last, ties by reach id.

    Ranked without a per-basin sort of the whole table when k = 1: a combinable maximum is enough.
    """
    if k == 1:
        best = F.max(F.struct(F.col("ord").isNotNull().alias("known"), F.col("ord"), (-F.col("feature_id")).alias("neg")))
        top = reach_map.groupBy("basin_id").agg(best.alias("b"))
        return top.select("basin_id", (-F.col("b.neg")).alias("feature_id"), "b.ord")
    order = W.partitionBy("basin_id").orderBy(F.col("ord").desc_nulls_last(), "feature_id")
    return reach_map.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def basin_metrics(metrics: DataFrame, top: DataFrame) -> DataFrame:
    """Mean of each metric over a basin's selected reaches."""
    joined = metrics.join(top.select("feature_id", "basin_id"), "feature_id", "inner")
    return joined.groupBy("basin_id").agg(*[F.avg(m).alias(m) for m in METRICS])
