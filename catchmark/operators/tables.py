"""Counting, sharing, binning and joining of facility, basin and region tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catchmark import SECTORS
from catchmark.functions import clean
from catchmark.operators.ordered import attach, exact_quantiles, require

TERTILES = ("low", "medium", "high")
QUARTILES = ("Q1", "Q2", "Q3", "Q4")


def dedupe_stress(stress: DataFrame, value: str = "bws_raw", key: str = "pfaf_id", sentinel: int = clean.SENTINEL_ID) -> DataFrame:
    """One value per basin key, without NULL and sentinel keys; fails if copies of a key disagree."""
    rows = stress.filter(F.col(key).isNotNull() & (F.col(key) != sentinel))
    one = rows.groupBy(key).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_set"), F.count(F.lit(1)).alias("_all")
    )
    agree = (F.col("_set") == 0) | ((F.col("_set") == F.col("_all")) & (F.col("_lo") == F.col("_hi")))
    return one.filter(require(agree, f"copies of one {key} carry different {value}")).select(key, F.col("_lo").alias(value))


def attach_stress(basins: DataFrame, stress: DataFrame, value: str = "bws_raw", dedupe: bool = True) -> DataFrame:
    """Left join of stress onto basins by the parent key; without ``dedupe`` repeated keys fan out."""
    side = dedupe_stress(stress, value) if dedupe else stress.select("pfaf_id", value)
    side = side.select(F.col("pfaf_id").alias("pfaf6"), F.col(value).alias("stress_value"))
    return basins.withColumn("pfaf6", clean.parent_key(F.col("pfaf_id"))).join(side, "pfaf6", "left")


def cut_points(df: DataFrame, value: str = "stress_value") -> DataFrame:
    """One row with the tertile and quartile cuts."""
    return exact_quantiles(df, [], value, {"t1": 1 / 3, "t2": 2 / 3, "q1": 0.25, "q2": 0.50, "q3": 0.75})


def bin_stress(df: DataFrame, cuts: DataFrame, value: str = "stress_value", tertile_labels=TERTILES) -> DataFrame:
    """Add stress_tertile and stress_quartile; ties go to the lower bin, NULL stays NULL."""
    v = F.col(value)
    binned = attach(df, cuts, []).withColumns(
        {
            "stress_tertile": clean.tertile(v, F.col("t1"), F.col("t2"), tertile_labels),
            "stress_quartile": clean.quartile(v, F.col("q1"), F.col("q2"), F.col("q3")),
        }
    )
    return binned.drop(*cuts.columns)


def presence_counts(located: DataFrame, id_col: str = "basin_id", sectors: Sequence[str] = SECTORS) -> DataFrame:
    """Facilities per polygon and sector, with a presence column of 1."""
    return located.groupBy(id_col, "sector").agg(F.count(F.lit(1)).alias("n")).withColumn("present", F.lit(1))


def presence_table(basins: DataFrame, located: DataFrame, id_col: str = "basin_id", sectors: Sequence[str] = SECTORS) -> DataFrame:
    """All basins with n_<sector> and <sector>_present, zero where a sector is absent."""
    counts = located.groupBy(id_col).agg(
        *[F.sum(F.when(F.col("sector") == s, 1).otherwise(0)).alias(f"n_{s}") for s in sectors]
    )
    others = [c for c in basins.columns if c != id_col]
    one = basins.groupBy(id_col).agg(*[F.min(c).alias(c) for c in others]) if others else basins.distinct()
    out = one.join(counts, id_col, "left")
    for s in sectors:
        out = out.withColumn(f"n_{s}", F.coalesce(F.col(f"n_{s}"), F.lit(0)).cast("bigint"))
    return out.withColumns({f"{s}_present": F.when(F.col(f"n_{s}") > 0, 1).otherwise(0) for s in sectors})


def master_table(presence: DataFrame, metrics: DataFrame, how: str = "inner", id_col: str = "basin_id") -> DataFrame:
    """Presence joined to basin metrics, with any_infra and the two-way group.

    ``inner`` also drops basins without the three tested metrics; ``left`` keeps every basin.
    """
    out = presence.join(metrics, id_col, how)
    flags = [F.col(f"{s}_present") for s in SECTORS]
    out = out.withColumn("any_infra", clean.any_flag(*flags))
    out = out.withColumn("group_excl", clean.two_way_group(F.col("any_infra")))
    return out.dropna(subset=["RBI", "season_conc", "CVQ"]) if how == "inner" else out


def overlapping_groups(df: DataFrame, with_non_ai: bool = False, with_none: bool = True) -> DataFrame:
    """Repeat each basin under every group it belongs to: each sector present, None, and optionally Non-AI."""
    ai, power, tri = (F.col(f"{s}_present") == 1 for s in SECTORS)
    labels = [F.when(ai, "AI"), F.when(power, "Power"), F.when(tri, "TRI")]
    if with_non_ai:
        labels.append(F.when(F.col("AI_present") == 0, "Non-AI"))
    if with_none:
        labels.append(F.when(~ai & ~power & ~tri, "None"))
    return df.withColumn("group", F.explode(F.array_compact(F.array(*labels))))


def region_shares(regions: DataFrame, located: DataFrame, totals: DataFrame | None = None, id_col: str = "huc2") -> DataFrame:
    """Count, percent and class of each region per sector.

    ``totals`` (sector, total) is the denominator: all domain points; without it the assigned points are used.
    """
    counts = located.groupBy("sector", id_col).agg(F.count(F.lit(1)).alias("count"))
    if totals is None:
        totals = located.groupBy("sector").agg(F.count(F.lit(1)).alias("total"))
    # regions x sectors: each region row is repeated for the few sectors of `totals`
    sectors = totals.agg(F.collect_list(F.struct("sector", "total")).alias("_s"))
    grid = attach(regions.select(id_col).distinct(), sectors, []).select(id_col, F.inline("_s"))
    out = grid.join(counts, ["sector", id_col], "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("bigint"))
    out = out.withColumn("pct", F.when(F.col("total") == 0, 0.0).otherwise(100.0 * F.col("count") / F.col("total")))
    return out.withColumn("class", clean.percent_class(F.col("pct")))


def top_shares(shares: DataFrame, min_pct: float = 3.0, n: int = 40, id_col: str = "huc2") -> DataFrame:
    """Per sector, the ``n`` largest shares at or above ``min_pct`` (a result table of one row per region)."""
    order = W.partitionBy("sector").orderBy(F.col("pct").desc(), F.col(id_col))
    return shares.filter(F.col("pct") >= min_pct).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def class_counts(df: DataFrame, keys: Sequence[str], labels: dict[str, Sequence[str]]) -> DataFrame:
    """(keys, label, pos, class, n) over the fixed class list of each label column, in one pass.

    Classes without rows count 0.
    """
    cells = [(label, i, c) for label, classes in labels.items() for i, c in enumerate(classes)]
    counted = [
        F.struct(
            F.lit(label).alias("label"), F.lit(i).alias("pos"), F.lit(c).alias("class"),
            F.sum(F.when(F.col(label) == c, 1).otherwise(0)).alias("n"),
        )
        for label, i, c in cells
    ]
    return df.groupBy(*keys).agg(F.array(*counted).alias("_c")).select(*keys, F.inline("_c"))


def class_percents(df: DataFrame, keys: Sequence[str] = ("sector",), label: str = "stress_tertile") -> DataFrame:
    """Low/Medium/High/Not_high/Total counts and percents per group; percents are NULL for an empty group."""
    names = {"low": "Low", "medium": "Medium", "high": "High"}
    out = df.groupBy(*keys).agg(
        *[F.sum(F.when(F.col(label) == c, 1).otherwise(0)).cast("bigint").alias(n) for c, n in names.items()]
    )
    out = out.withColumns({"Not_high": F.col("Low") + F.col("Medium"), "Total": F.col("Low") + F.col("Medium") + F.col("High")})
    return out.withColumns({f"{n}_percent": clean.safe_ratio(100.0 * F.col(n), F.col("Total")) for n in names.values()})


def class_proportions(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each class's share of its group, with an empty group counted as one."""
    total = F.sum("n").over(W.partitionBy(*keys))
    return counts.withColumn("share", F.col("n") / F.greatest(F.lit(1), total))


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join that fails when a key repeats on either side."""
    keys = list(keys)

    def unique(df, side):
        n = F.count(F.lit(1)).over(W.partitionBy(*keys))
        return df.withColumn("_n", n).filter(require(F.col("_n") == 1, f"repeated key on the {side} side")).drop("_n")

    return unique(left, "left").join(unique(right, "right"), keys, how)


def union_parts(*parts: DataFrame) -> DataFrame:
    """Union by column name, duplicates kept, missing columns NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


# Column headers of the printed test tables.
SHORT_HEADERS = {
    "MedianDiff_sector_minus_matched": "MedianΔ",
    "MedianDiff_sector_minus_none": "MedianΔ",
    "p_two_bootstrap": "p (2-sided)",
    "CI95_low": "CI95 low",
    "CI95_high": "CI95 high",
    "BaselinePool": "Baseline",
    "N_sector": "N",
    "CompareTo": "Compare",
    "KS_D": "KS D",
    "KS_p": "KS p",
    "KS_pFDR": "KS p(FDR)",
    "MWU_p": "MWU p",
    "MWU_pFDR": "MWU p(FDR)",
}


def short_headers(df: DataFrame) -> DataFrame:
    """Printed column names, with Metric and Sector moved to the front."""
    front = [c for c in ("Metric", "Sector") if c in df.columns]
    ordered = df.select(*front, *[c for c in df.columns if c not in front])
    return ordered.withColumnsRenamed({c: n for c, n in SHORT_HEADERS.items() if c in df.columns})


def nearest_summary(found: DataFrame, n_sites: DataFrame, dist: str = "dist_km", within: float = 10.0) -> DataFrame:
    """One row: number of sites, and mean, median and share within ``within`` over all joined rows (ties included)."""
    clean_rows = found.filter(F.col(dist).isNotNull())
    body = clean_rows.agg(
        F.avg(dist).alias("mean_dist"), F.avg(F.when(F.col(dist) <= within, 1.0).otherwise(0.0)).alias("share_within")
    )
    median = exact_quantiles(clean_rows, [], dist, {"median_dist": 0.5})
    return attach(attach(n_sites, body, []), median, [])
