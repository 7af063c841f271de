"""Do water-stress classes of facility sites differ among sectors, and from random places?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchmark import SECTORS
from catchmark.functions.clean import significant
from catchmark.functions.geometry import project_edges
from catchmark.operators.contingency import chi_square, odds_ratio
from catchmark.operators.lineage import cut
from catchmark.operators.ordered import attach
from catchmark.operators.polygons import points_in_polygons
from catchmark.operators.sampling import area_index, grouped_draws, points_in_areas, random_points_in_polygons, reproducible_first
from catchmark.operators.tables import QUARTILES, TERTILES, attach_stress, bin_stress, class_counts, class_percents, cut_points, union_parts
from catchmark.sources.readers import check_inputs, clean_edges, clean_stress, load_points, read_table
from catchmark.sources.writers import cached_table, write_csv

BINS = ("stress_value", "stress_tertile", "stress_quartile")
# Seeds and sizes of the reference draws.
REFERENCE_N, BASE_SEED, MODE_SEED = 300_000, 7, {"ALL_BASINS": 10_000, "GLOBAL": 10_000, "BASIN_MATCHED": 20_000}
SECTOR_SEED = {"AI": 101, "Power": 202, "TRI": 303}
POOL_FACTOR, POOL_LEAST = 5, 1000


def binned_basins(basins: DataFrame, stress: DataFrame, value: str = "bws_raw", dedupe: bool = True) -> DataFrame:
    """Basins with stress value, tertile and quartile; the cuts are over one row per level-8 basin."""
    joined = attach_stress(basins, stress, value, dedupe)
    return bin_stress(joined, cut_points(joined))


def attach_bins(located: DataFrame, binned: DataFrame) -> DataFrame:
    """Stress attributes of each located point; points without a class are dropped."""
    return located.join(binned.select("basin_id", "pfaf_id", *BINS), "basin_id").dropna(subset=["pfaf_id", *BINS])


def facilities_with_stress(facilities: DataFrame, edges: DataFrame, binned: DataFrame) -> DataFrame:
    """Facilities inside a classified basin, in lon/lat."""
    return attach_bins(points_in_polygons(facilities, edges, "inner"), binned)


def reference_points(
    spark: SparkSession, edges: DataFrame, binned: DataFrame, n: int = REFERENCE_N, seed: int = BASE_SEED + 10_000
) -> DataFrame:
    """One equal-area random reference for all sectors: ``n`` points in EPSG:5070, unclassified ones dropped."""
    points = random_points_in_polygons(spark, cut(project_edges(edges), "edges"), n, seed)
    return attach_bins(points, binned).withColumn("sector", F.lit("Reference"))


def matched_reference(
    spark: SparkSession, facilities: DataFrame, edges: DataFrame, binned: DataFrame, mode: str = "GLOBAL"
) -> DataFrame:
    """Per sector, as many random points as it has facilities, in lon/lat.

    GLOBAL draws over all basins, BASIN_MATCHED only over basins that hold a facility of the sector. The pool is five
    times the facilities, at least a thousand more, and is doubled while fewer of its points are classified than needed.
    """
    if mode not in ("GLOBAL", "BASIN_MATCHED"):
        raise ValueError("mode must be GLOBAL or BASIN_MATCHED")
    # one index of the polygons' areas and one draw serve all sectors
    facilities, binned = cut(facilities, "facilities"), cut(binned.select("basin_id", "pfaf_id", *BINS), "binned")
    sizes = {r["sector"]: r["count"] for r in facilities.groupBy("sector").count().collect() if r["sector"] is not None}  # one row per sector
    keys = ["sector"] if mode == "BASIN_MATCHED" else []
    area = edges
    if keys:
        held = facilities.select("sector", "basin_id").filter("basin_id is not null").distinct()
        area = edges.join(held, "basin_id")
    index = area_index(area, keys=keys)
    seeds = {s: BASE_SEED + SECTOR_SEED.get(s, 0) + MODE_SEED[mode] for s in sizes}
    wanted = {s: max(n + POOL_LEAST, POOL_FACTOR * n) for s, n in sizes.items()}
    pools, parts = dict.fromkeys(sizes), []
    while short := [s for s in sizes if pools[s] is None]:
        # Few classified basins leave few points of a pool: it grows until it holds enough.
        asked = spark.createDataFrame([(s, seeds[s], wanted[s]) for s in short], "sector string, seed int, n long")
        pool = cut(attach_bins(points_in_areas(index, grouped_draws(asked, ["sector"]), "seed", keys=keys), binned).drop("seed"), "pool")
        got = {r["sector"]: r["count"] for r in pool.groupBy("sector").count().collect()}  # one row per sector
        for s in short:
            if got.get(s, 0) >= sizes[s]:
                pools[s] = pool.filter(F.col("sector") == s)
            elif not got.get(s, 0) and wanted[s] >= 1000 * (sizes[s] + POOL_LEAST):
                raise ValueError(f"no classified basin to draw reference points of {s} in")
            wanted[s] *= 2
    for sector in sorted(sizes, key=lambda s: (s not in SECTORS, SECTORS.index(s) if s in SECTORS else 0, s)):
        parts.append(reproducible_first(pools[sector], "draw", sizes[sector], SECTOR_SEED.get(sector, 0), must_fill=True))
    return union_parts(*parts)


LABELS = {"stress_tertile": TERTILES, "stress_quartile": QUARTILES}


def sector_vs_reference(facilities: DataFrame, reference: DataFrame, mode: str, per_sector: bool = False) -> DataFrame:
    """Chi-square over tertiles and quartiles and the odds ratios of the top class, one row per sector.

    ``per_sector`` compares each sector with its own matched points, else all with the common reference. Both
    inputs are read once; every test works on the class counts.
    """
    seen = class_counts(facilities, ["sector"], LABELS).withColumn("side", F.lit(0))
    if per_sector:
        drawn = class_counts(reference, ["sector"], LABELS).withColumn("side", F.lit(1))
        counts = cut(seen.unionByName(drawn), "class-counts")
        # a sector is compared only when it has both sides
        paired = counts.groupBy("sector").agg(F.count_distinct("side").alias("_s")).filter("_s = 2").select("sector")
        both = counts.join(paired, "sector", "left_semi")
    else:
        common = class_counts(reference, [], LABELS).withColumns({"sector": F.lit("Reference"), "side": F.lit(1)})
        counts = cut(seen.unionByName(common), "class-counts")
        # the reference row of each class is repeated under every sector
        sectors = counts.filter("side = 0").agg(F.collect_set("sector").alias("_s"))
        repeated = attach(counts.filter("side = 1").drop("sector"), sectors, []).withColumn("sector", F.explode("_s")).drop("_s")
        both = counts.filter("side = 0").unionByName(repeated)
    chi = chi_square(both, ["sector", "label"], "side", "class")
    top = F.col("class").isin("high", "Q4")
    cell = lambda side, c: F.sum(F.when((F.col("side") == side) & c, F.col("n")).otherwise(0))
    cells = both.groupBy("sector", "label").agg(
        cell(0, top).alias("a"), cell(0, ~top).alias("b"), cell(1, top).alias("c"), cell(1, ~top).alias("d")
    )
    ratio, lo, hi = odds_ratio(*[F.col(x) for x in "abcd"])
    rows = chi.select("sector", "label", "chi2", "p").join(
        cells.select("sector", "label", (F.col("a") + F.col("b")).alias("N"), ratio.alias("r"), lo.alias("lo"), hi.alias("hi")), ["sector", "label"]
    )
    pick = lambda label, c, name: F.max(F.when(F.col("label") == label, F.col(c))).alias(name)
    return rows.groupBy(F.col("sector").alias("Sector")).agg(
        F.max("N").alias("N_with_stress"),
        *[
            pick(label, c, name)
            for label, names in (
                ("stress_tertile", ("Chi2_tertiles", "p_tertiles", "OR_high", "OR_high_lo", "OR_high_hi")),
                ("stress_quartile", ("Chi2_quartiles", "p_quartiles", "OR_Q4", "OR_Q4_lo", "OR_Q4_hi")),
            )
            for c, name in zip(("chi2", "p", "r", "lo", "hi"), names)
        ],
    ).select(F.lit(mode).alias("Mode"), "*")


def direct_tests(percents: DataFrame) -> DataFrame:
    """One row: the 3x3 test of classes and the 3x2 test of High against Not_high, among sectors."""
    tests = {"full_distribution": ["Low", "Medium", "High"], "high_vs_not_high": ["High", "Not_high"]}
    rows = [
        chi_square(percents.unpivot(["Sector"], classes, "class", "n"), [], "Sector", "class").select(
            F.col("chi2").alias(f"Chi2_{tag}"), F.col("dof").alias(f"df_{tag}"), F.col("p").alias(f"p_{tag}"),
            F.col("cramers_v").alias(f"Cramers_V_{tag}"), F.col("n").alias(f"n_{tag}"),
        )
        for tag, classes in tests.items()
    ]
    return attach(rows[0], rows[1], [])


def sector_percents(facilities: DataFrame) -> DataFrame:
    """Class counts per sector, written once for the tests that share them."""
    return cut(class_percents(facilities).withColumnRenamed("sector", "Sector"), "class-percents")


def direct_comparison(facilities: DataFrame, mode: str = "ALL_BASINS") -> DataFrame:
    """Class counts and percents per sector with both direct tests repeated on each row."""
    percents = sector_percents(facilities)
    tests = direct_tests(percents).drop("n_full_distribution", "n_high_vs_not_high")
    out = attach(percents, tests, []).withColumn("High_test_significant", significant(F.col("p_high_vs_not_high")))
    return out.select(F.lit(mode).alias("Mode"), *out.columns)


def direct_summary(facilities: DataFrame, mode: str = "ALL_BASINS") -> DataFrame:
    """The one-row summary of the direct comparison."""
    t = direct_tests(sector_percents(facilities))
    return t.select(
        F.lit(mode).alias("Mode"),
        F.lit("AI_vs_Power_vs_TRI").alias("Sector"),
        F.col("n_high_vs_not_high").alias("N_with_stress"),
        *[F.col(f"{c}_full_distribution").alias(f"{c}_direct_full") for c in ("Chi2", "df", "p", "Cramers_V")],
        *[F.col(f"{c}_high_vs_not_high").alias(f"{c}_direct_high") for c in ("Chi2", "df", "p", "Cramers_V")],
    )


def run(
    spark: SparkSession, points: dict[str, str], basins: str, basin_edges: str, stress: str, out: str, value: str = "bws_raw",
    sectors: Sequence[str] = SECTORS, reference_n: int = REFERENCE_N, recompute: bool = False,
) -> dict[str, DataFrame]:
    """Whole analysis from input paths; the joined tables are written once and reused by every test."""
    check_inputs(spark, [*points.values(), basins, basin_edges, stress])
    edges = clean_edges(read_table(spark, basin_edges), "basin_id")
    binned = cached_table(
        spark, f"{out}/cache/basins",
        lambda: binned_basins(read_table(spark, basins), clean_stress(read_table(spark, stress), value), value), recompute, value=value, basins=basins, stress=stress,
    )
    fac = cached_table(
        spark, f"{out}/cache/facilities",
        lambda: facilities_with_stress(
            union_parts(*[load_points(spark, points[s], s).select("sector", "lon", "lat") for s in sectors]), edges, binned
        ), recompute, value=value, basins=basins, stress=stress, edges=basin_edges, points=sorted((s, points[s]) for s in sectors),
    )
    ref = cached_table(
        spark, f"{out}/cache/reference", lambda: reference_points(spark, edges, binned, reference_n), recompute,
        n=reference_n, value=value, basins=basins, stress=stress, edges=basin_edges,
    )
    tables = {
        "facilities_with_stress": fac,
        "reference_with_stress": ref,
        "direct_comparison": direct_comparison(fac),
        "direct_summary": direct_summary(fac),
        "sector_vs_reference": sector_vs_reference(fac, ref, "ALL_BASINS"),
    }
    for name, table in tables.items():
        write_csv(table, f"{out}/{name}")
    return tables


def matched_stress(spark: SparkSession, facilities: DataFrame, edges: DataFrame, binned: DataFrame, mode: str = "GLOBAL") -> DataFrame:
    """Each sector against its own matched random points."""
    reference = cut(matched_reference(spark, facilities, edges, binned, mode), "matched-reference")
    return sector_vs_reference(facilities, reference, mode, per_sector=True)


def run_matched(
    spark: SparkSession, points: dict[str, str], basins: str, basin_edges: str, stress: str, out: str, value: str = "bws_raw"
) -> dict[str, DataFrame]:
    """The matched test from input paths, in both modes."""
    check_inputs(spark, [*points.values(), basins, basin_edges, stress])
    edges = clean_edges(read_table(spark, basin_edges), "basin_id")
    binned = cut(binned_basins(read_table(spark, basins), clean_stress(read_table(spark, stress), value), value), "binned")
    sites = union_parts(*[load_points(spark, path, s).select("sector", "lon", "lat") for s, path in points.items()])
    facilities = cut(facilities_with_stress(sites, edges, binned), "facilities")
    tables = {mode: matched_stress(spark, facilities, edges, binned, mode) for mode in ("GLOBAL", "BASIN_MATCHED")}
    for mode, table in tables.items():
        write_csv(table, f"{out}/sector_vs_reference_{mode.lower()}")
    return tables
