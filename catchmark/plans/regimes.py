"""Do basins with facilities have different streamflow regimes from basins without?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchmark import SECTORS
from catchmark.functions.clean import exclusive_group
from catchmark.functions.text import fmt_median_iqr
from catchmark.operators import hydrology as hy
from catchmark.operators.bootstrap import bootstrap_two_sample, bootstrap_vs_pool, ecdf_band
from catchmark.operators.distributions import (
    axis_limits, bh_fdr_results, ecdf_on_grid, linear_grid, rank_comparison, ranked_rows, value_counts,
)
from catchmark.operators.lineage import cut
from catchmark.operators.ordered import exact_quantiles
from catchmark.operators.polygons import points_in_polygons, reach_map
from catchmark.operators.tables import master_table, overlapping_groups, presence_table, union_parts
from catchmark.sources.readers import check_inputs, clean_edges, load_points, read_table
from catchmark.sources.writers import cached_table, resumed_table, write_csv

TESTED = ("RBI", "season_conc", "CVQ")
TABLE_METRICS = ("meanQ", "CVQ", "Q10", "Q90", "RBI", "season_conc")
START, END = "2003-01-01", "2020-12-31"


def reach_metrics(flow: DataFrame, top: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """Seven metrics of every selected reach within the window."""
    return hy.regime_metrics(hy.daily_mean(hy.flow_window(hy.flow_column(flow), start, end, top)))


def group_values(master: DataFrame, metrics: Sequence[str] = TESTED, exclusive: bool = False) -> DataFrame:
    """(group, metric, basin_id, x): long values; sectors overlap unless ``exclusive``."""
    if exclusive:
        label = exclusive_group(*[F.col(f"{s}_present") for s in SECTORS])
        grouped = master.withColumn("group", label)
    else:
        grouped = overlapping_groups(master)
    long = grouped.unpivot(["group", "basin_id"], list(metrics), "metric", "x")
    return long.filter(F.col("x").isNotNull() & ~F.isnan("x"))


def written_ranks(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The long values and their ranks per group and metric, both written once for the steps that share them."""
    values = cut(values, "group-values")
    return values, cut(ranked_rows(values, ["group", "metric"], "x", "basin_id"), "group-ranks")


def effect_table(values: DataFrame, reps: int = 500, seed: int = 42) -> DataFrame:
    """Median difference of each sector and metric against size-matched draws (with replacement) of the None pool."""
    values, ranked = written_ranks(values)
    out = bootstrap_vs_pool(values, ranked, SECTORS, TESTED, reps, seed, replace=True, min_n=3)
    return out.select(
        F.col("sector").alias("Sector"), F.col("metric").alias("Metric"), F.col("n").alias("N_sector"), F.col("m").alias("N_none_pool"),
        F.col("median_sector").alias("Median_sector"), F.col("median_pool").alias("Median_matched_baseline"),
        F.col("d_med").alias("MedianDiff_sector_minus_matched"), F.col("d_lo").alias("CI95_low"), F.col("d_hi").alias("CI95_high"),
    )


def matched_effect_table(values: DataFrame, reps: int = 800, seed: int = 7) -> DataFrame:
    """As ``effect_table`` without replacement, for groups of at least 30, with a two-sided p."""
    values, ranked = written_ranks(values)
    out = bootstrap_vs_pool(values, ranked, SECTORS, TESTED, reps, seed, replace=False, min_n=30)
    return out.select(
        F.col("sector").alias("Sector"), F.col("metric").alias("Metric"), F.col("n").alias("N_sector"),
        F.col("d_med").alias("MedianDiff_sector_minus_matched"), F.col("d_lo").alias("CI95_low"), F.col("d_hi").alias("CI95_high"),
        F.col("p_two").alias("p_two_bootstrap"),
    )


def tests_vs_none(values: DataFrame, reps: int = 2000, seed: int = 7, min_n: int = 30) -> DataFrame:
    """Sector against None per metric: KS, Mann-Whitney, bootstrap interval of the median difference, FDR."""
    values, ranked = written_ranks(values)
    # each sector meets the None pool: None rows are listed once per sector
    first = values.filter(F.col("group").isin(*SECTORS)).select("metric", F.col("group").alias("sector"), F.lit(True).alias("_a"), "x")
    pool = values.filter(F.col("group") == "None").select(
        "metric", F.explode(F.array(*[F.lit(s) for s in SECTORS])).alias("sector"), F.lit(False).alias("_a"), "x"
    )
    ranks = rank_comparison(first.unionByName(pool), ["metric", "sector"], "x", F.col("_a"))
    ranks = ranks.filter((F.col("n_first") >= min_n) & (F.col("n_second") >= min_n))
    boot = bootstrap_two_sample(values, ranked, SECTORS, TESTED, reps, seed, min_n).select("sector", "metric", "d", "d_lo", "d_hi")
    out = bh_fdr_results(bh_fdr_results(ranks, "ks_p", "ks_q"), "mwu_p", "mwu_q").join(boot, ["sector", "metric"])
    return out.select(
        F.col("metric").alias("Metric"), F.col("sector").alias("Sector"), F.lit("None").alias("CompareTo"),
        F.col("n_first").alias("N_sector"), F.col("n_second").alias("N_none"), F.col("d").alias("MedianDiff_sector_minus_none"),
        F.col("d_lo").alias("CI95_low"), F.col("d_hi").alias("CI95_high"), F.col("ks_d").alias("KS_D"), F.col("ks_p").alias("KS_p"),
        F.col("mwu_p").alias("MWU_p"), F.col("ks_q").alias("KS_pFDR"), F.col("mwu_q").alias("MWU_pFDR"),
    )


def median_iqr_table(master: DataFrame, metrics: Sequence[str] = TABLE_METRICS) -> DataFrame:
    """Metric x {AI, Non-AI, Power, TRI} with 'median [q1, q3]' cells."""
    groups = ("AI", "Non-AI", "Power", "TRI")
    long = overlapping_groups(master, with_non_ai=True, with_none=False).unpivot(["group"], list(metrics), "Metric", "x")
    cuts = exact_quantiles(long, ["Metric", "group"], "x", {"q1": 0.25, "med": 0.5, "q3": 0.75})
    cell = fmt_median_iqr(F.col("med"), F.col("q1"), F.col("q3"))
    return cuts.groupBy("Metric").agg(
        *[F.coalesce(F.max(F.when(F.col("group") == g, cell)), F.lit("")).alias(f"{g} basins") for g in groups]
    )


def metric_grid(master: DataFrame, points: int = 250) -> DataFrame:
    """(metric, g, x): even grid between the 1% and 99.5% quantiles over all basins (99% for CVQ)."""
    long = master.unpivot(["basin_id"], list(TESTED), "metric", "x")
    wide = [axis_limits(long.filter(F.col("metric") == m), ["metric"], "x", 0.01, 0.99 if m == "CVQ" else 0.995) for m in TESTED]
    return linear_grid(union_parts(*wide), ["metric"], "lo", "hi", points)


def effect_bands(master: DataFrame, reps: int = 500, seed: int = 42) -> DataFrame:
    """(sector, metric, g, x, b_med, b_lo, b_hi): bands of size-matched draws of the None pool."""
    master = cut(master, "master")
    values = group_values(master)
    grid = cut(metric_grid(master), "grid")
    none = value_counts(values.filter("group = 'None'"), ["metric"], "x")
    each = F.explode(F.array(*[F.lit(s) for s in SECTORS]))
    pool = cut(ecdf_on_grid(none, grid, ["metric"]).withColumn("sector", each), "pool-ecdf")
    return ecdf_band(values, grid.withColumn("sector", each), SECTORS, TESTED, pool.select("sector", "metric", "g", "y"), reps, seed)


def run(
    spark: SparkSession, points: dict[str, str], basins: str, basin_edges: str, reaches: str, flow: str, out: str,
    start: str = START, end: str = END, recompute: bool = False,
) -> dict[str, DataFrame]:
    """Whole analysis from input paths; ``recompute`` rebuilds the basins' metrics, the other caches are reused.

    Metrics of reaches are built in parts: a run that broke off goes on with the reaches that are left, as does one with more reaches.
    """
    check_inputs(spark, [*points.values(), basins, basin_edges, reaches, flow])
    edges = clean_edges(read_table(spark, basin_edges), "basin_id")
    facilities = union_parts(*[load_points(spark, path, s, pick="last_exact").select("sector", "lon", "lat") for s, path in points.items()])
    presence = cut(presence_table(read_table(spark, basins).select("basin_id"), points_in_polygons(facilities, edges, "inner")), "presence")
    mapping = cached_table(spark, f"{out}/cache/reach_map", lambda: reach_map(read_table(spark, reaches), edges), reaches=reaches, edges=basin_edges)
    top = cut(hy.top_reaches(mapping), "top-reaches")
    per_reach = lambda: resumed_table(
        spark, f"{out}/cache/reach_metrics", top.select("feature_id"), lambda some: reach_metrics(read_table(spark, flow), some, start, end),
        start=start, end=end, flow=flow,
    )
    metrics = cached_table(
        spark, f"{out}/cache/basin_metrics", lambda: hy.basin_metrics(per_reach(), top), recompute,
        start=start, end=end, flow=flow, reaches=reaches, edges=basin_edges,
    )
    master = cached_table(spark, f"{out}/cache/master", lambda: master_table(presence, metrics), recompute=True)
    tables = {"presence": presence, "selected_reaches": top, "master": master, "effects": effect_table(group_values(master))}
    for name, table in tables.items():
        write_csv(table, f"{out}/{name}")
    return tables
