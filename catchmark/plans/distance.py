"""Distance from facilities to water, and its comparison with random places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchmark.functions.clean import keep_values, nearest_kind
from catchmark.functions.geometry import project_edges, project_points, utm_xy, utm_zone
from catchmark.functions.text import fmt_num, fmt_p, fmt_range
from catchmark.operators.distributions import bh_fdr_results, descriptives, median_difference, rank_comparison
from catchmark.operators.lineage import cut
from catchmark.operators.models import fit_distance_logit, presence_frame
from catchmark.operators.nearest import nearest_distance
from catchmark.operators.polygons import domain_filter
from catchmark.operators.sampling import area_index, grouped_draws, points_in_areas
from catchmark.operators.tables import one_to_one, union_parts
from catchmark.sources.readers import DISTANCE_COLS, check_inputs, load_distances, major_rivers
from catchmark.sources.writers import write_csv

KINDS = ("River", "Lake", "Coast")
#: Degrees beyond a zone in which lines are looked for first.
MARGIN = 2.0
# What a sector adds to the seed of its draw.
SEED_OFFSETS = {"AI": 101, "Power": 202, "TRI": 303}


def nearest_river_km(sites: DataFrame, segments: DataFrame, site_id: str, min_order: int = 5, depth: int | None = None) -> DataFrame:
    """(site, dist_km) to major rivers in EPSG:5070."""
    rivers = project_edges(major_rivers(segments, min_order))
    found = nearest_distance(project_points(sites), rivers, site_id, depth=depth)
    return found.select(site_id, (F.col("dist") / 1000.0).alias("dist_km"))


def _wide(sites: DataFrame, found: DataFrame, site_id: str) -> DataFrame:
    """One row for every site; a kind of water that was not found is NULL."""
    names = {"River": "dist_river_km", "Lake": "dist_lake_km", "Coast": "dist_coast_km"}
    wide = found.groupBy(site_id).agg(
        *[F.min(F.when(F.col("kind") == k, F.col("dist") / 1000.0)).alias(c) for k, c in names.items()]
    )
    wide = sites.select(site_id).join(wide, site_id, "left")
    return wide.withColumns(
        {"dist_any_km": F.least(*names.values()), "nearest": nearest_kind({k: F.col(c) for k, c in names.items()})}
    )


def nearest_water(sites: DataFrame, segments: DataFrame, site_id: str, min_order: int = 5, depth: int | None = None) -> DataFrame:
    """Distances to the nearest river, lake shore and coast in EPSG:5070, their minimum and its kind."""
    keep = segments.filter((F.col("kind") != "River") | (F.col("ord") >= min_order))
    found = nearest_distance(project_points(sites), project_edges(keep), site_id, segment_keys=["kind"], depth=depth)
    return _wide(sites, found, site_id)


def nearest_water_utm(sites: DataFrame, segments: DataFrame, site_id: str, min_order: int = 3, depth: int | None = None) -> DataFrame:
    """As ``nearest_water`` but in each site's own UTM zone.

    A zone that holds a site (at most 60) first gets the lines that reach within MARGIN degrees of it. Lines left out lie beyond that meridian, so a
    distance shorter than the way there is final; other sites are searched again among all lines of their zone and kind. Zones are matched by key.
    Lines 80 degrees or more from a zone's meridian lie outside that projection and are left out for the zone.
    """
    placed = sites.withColumn("zone", utm_zone(F.col("lon")))
    x, y = utm_xy(F.col("lon"), F.col("lat"), F.col("zone"))
    placed = cut(placed.withColumns({"x": x, "y": y}).select(site_id, "zone", "x", "y"), "utm-sites")
    zones = F.broadcast(placed.agg(F.collect_set("zone").alias("_zones")))  # one row, at most 60 zones
    ends = ("x1", "y1", "x2", "y2")
    # written once: filters on zones would be pushed into the expressions of the ends
    keep = cut(segments.filter((F.col("kind") != "River") | (F.col("ord") >= min_order)).select("kind", *ends), "water-lines")
    meridian = F.col("zone") * 6.0 - 183.0
    lines = keep.crossJoin(zones).withColumn("zone", F.explode("_zones")).drop("_zones")
    lines = lines.filter((F.abs(F.col("x1") - meridian) < 80.0) & (F.abs(F.col("x2") - meridian) < 80.0))
    span = 3.0 + MARGIN
    near = lines.filter((F.least("x1", "x2") <= meridian + span) & (F.greatest("x1", "x2") >= meridian - span))
    found = cut(nearest_distance(placed, _in_zone(near), site_id, ["zone"], ["kind"], depth), "near-water")

    # a meridian is nearest to the zone's own at the latitude farthest from the equator; both ends of a line left out lie beyond, and so does the line.
    # The series' terms of higher order come to less than a hundredth there.
    steep = lambda c: F.max(F.when(~F.isnan(c), F.abs(F.sin(F.radians(c)))))
    kinds = keep.groupBy("kind").agg(F.greatest(steep("y1"), steep("y2")).alias("_sin")).filter("kind is not null")
    way = utm_xy(F.lit(span - 3.0), F.degrees(F.asin("_sin")), F.lit(30))[0]  # zone 30 lies around -3 degrees
    kinds = cut(kinds.select("kind", (way - 500_000.0).alias("_way")), "water-kinds")
    off = placed.groupBy("zone", site_id).agg(F.max(F.abs(F.col("x") - 500_000.0)).alias("_off"))
    sure = found.join(kinds, "kind").join(off, ["zone", site_id]).filter(F.col("dist") <= F.col("_way") * 0.99 - F.col("_off"))
    sure = cut(sure.select("zone", site_id, "kind", "dist"), "sure-water")
    rest = cut(placed.crossJoin(kinds.select("kind")).join(sure, ["zone", site_id, "kind"], "left_anti"), "unsure-water")
    if rest.isEmpty():
        return _wide(sites, sure, site_id)
    some = F.broadcast(cut(rest.select("zone", "kind").distinct(), "unsure-zones"))  # at most 60 zones of each kind
    more = nearest_distance(rest, _in_zone(lines.join(some, ["zone", "kind"], "left_semi")), site_id, ["zone", "kind"], (), depth)
    return _wide(sites, sure.unionByName(more), site_id)


def _in_zone(lines: DataFrame) -> DataFrame:
    """Ends in the UTM zone of each line."""
    (ax, ay), (bx, by) = (utm_xy(F.col(f"x{n}"), F.col(f"y{n}"), F.col("zone")) for n in (1, 2))
    return lines.withColumns({"x1": ax, "y1": ay, "x2": bx, "y2": by})


def tests_vs_random(distances: DataFrame, column: str) -> DataFrame:
    """KS, Mann-Whitney, Cliff's delta and median difference of sector against random, with FDR q-values."""
    rows = keep_values(distances, column, 0.0, strict=True)
    is_sector = F.col("grp") == "sector"
    out = rank_comparison(rows, ["sector"], column, is_sector).join(
        median_difference(rows, ["sector"], column, is_sector).select("sector", "median_diff"), "sector"
    )
    out = bh_fdr_results(bh_fdr_results(out, "ks_p", "ks_q"), "mwu_p", "mwu_q")
    return out.select(F.lit(column).alias("distance_column"), *out.columns)


def wide_descriptives(distances: DataFrame, column: str) -> DataFrame:
    """Descriptives of both groups side by side, one row per sector."""
    desc = descriptives(keep_values(distances, column, 0.0, strict=True), ["sector", "grp"], column)
    half = lambda g: desc.filter(F.col("grp") == g).select(
        "sector", *[F.col(c).alias(f"{c}_{g}") for c in ("n", "median", "q1", "q3", "mean")]
    )
    return one_to_one(half("sector"), half("random"), ["sector"])


def journal_table(distances: DataFrame, column: str) -> DataFrame:
    """The printed comparison table: text cells, one row per sector."""
    t = one_to_one(wide_descriptives(distances, column), tests_vs_random(distances, column), ["sector"])
    return t.select(
        F.col("sector").alias("Sector"),
        F.col("n_sector").alias("N_sector"),
        fmt_num(F.col("median_sector"), 2).alias("Median (sector)"),
        fmt_range(F.col("q1_sector"), F.col("q3_sector")).alias("IQR (sector)"),
        F.col("n_random").alias("N_random"),
        fmt_num(F.col("median_random"), 2).alias("Median (random)"),
        fmt_range(F.col("q1_random"), F.col("q3_random")).alias("IQR (random)"),
        fmt_num(F.col("ks_d"), 3).alias("KS D"),
        fmt_p(F.col("ks_p")).alias("KS p"),
        fmt_p(F.col("ks_q")).alias("KS q(FDR)"),
        fmt_p(F.col("mwu_p")).alias("MWU p"),
        fmt_p(F.col("mwu_q")).alias("MWU q(FDR)"),
        fmt_num(F.col("cliffs_delta"), 3).alias("Cliff's δ"),
        fmt_num(F.col("median_diff"), 2).alias("Δ median (sector-random)"),
    ).orderBy("Sector")


def matched_distances(
    spark: SparkSession, facilities: DataFrame, basin_edges: DataFrame, segments: DataFrame, min_order: int = 5, seed: int = 7,
    depth: int | None = None,
) -> DataFrame:
    """(sector, grp, dist_km): facilities inside basins and as many random points, with distance to major rivers.

    All sectors and both groups go through one nearest-distance join.
    """
    edges = cut(project_edges(basin_edges), "edges")
    inside = cut(domain_filter(project_points(facilities), edges, "x", "y"), "domain-points")
    # as many draws for each sector, from one index of the basins' areas
    offsets = F.create_map(*[F.lit(v) for pair in SEED_OFFSETS.items() for v in pair])
    asked = cut(inside.groupBy("sector").agg(F.count(F.lit(1)).alias("n")).withColumn("seed", F.coalesce(F.element_at(offsets, F.col("sector")), F.lit(0)) + seed), "asked")
    drawn = points_in_areas(area_index(edges), grouped_draws(asked, ["sector"]), "seed")
    parts = [inside.select("sector", F.lit("sector").alias("grp"), F.col("site_id").alias("k"), "x", "y")]
    parts.append(drawn.select("sector", F.lit("random").alias("grp"), F.col("draw").alias("k"), "x", "y"))
    points = union_parts(*parts).withColumn("pid", F.concat_ws("|", "sector", "grp", F.col("k").cast("string")))
    points = cut(points.select("pid", "x", "y"), "points")
    found = nearest_distance(points, project_edges(major_rivers(segments, min_order)), "pid", depth=depth)
    return found.select(
        F.element_at(F.split("pid", r"\|"), 1).alias("sector"),
        F.element_at(F.split("pid", r"\|"), 2).alias("grp"),
        (F.col("dist") / 1000.0).alias("dist_km"),
    )


def logit_table(distances: DataFrame) -> DataFrame:
    """One logistic fit per sector on (sector, grp, dist_km), sorted by sector; all sectors are fitted together.

    Sectors without either group have no row; a sector whose fit has no finite optimum has NULL results.
    """
    distances = cut(distances, "distances")
    side = lambda g: F.count_if(F.col("grp") == g).alias(f"n_{g}")
    sizes = distances.groupBy("sector").agg(side("sector"), side("random")).filter("n_sector > 0 and n_random > 0")
    frame = presence_frame(distances.filter("grp = 'sector'"), distances.filter("grp = 'random'"), keys=["sector"])
    fits = fit_distance_logit(frame, ["sector"])
    return sizes.join(fits, "sector").orderBy("sector")


def run(spark: SparkSession, paths: dict[tuple[str, str], str], out: str) -> dict[str, DataFrame]:
    """Whole comparison from the distance files, one for each (sector, "sector" or "random")."""
    check_inputs(spark, paths.values())
    distances = cut(load_distances(spark, paths), "distances")
    tables = {column: journal_table(distances, column) for column in (*DISTANCE_COLS, "dist_any_km")}
    for name, table in tables.items():
        write_csv(table, f"{out}/{name}")
    return tables
