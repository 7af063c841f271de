"""Share of each sector's facilities per hydrologic region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchmark.functions.clean import valid_region, zfill
from catchmark.functions.geometry import project_edges, project_points
from catchmark.operators.lineage import cut
from catchmark.operators.polygons import domain_filter, points_in_polygons
from catchmark.operators.tables import region_shares, top_shares, union_parts
from catchmark.sources.readers import check_inputs, clean_edges, load_points, read_table
from catchmark.sources.writers import write_csv


def padded_regions(regions: DataFrame, id_col: str = "huc2") -> DataFrame:
    """Two-digit region ids without the regions outside the conterminous domain."""
    return regions.withColumn(id_col, zfill(F.col(id_col).cast("string"), 2)).filter(valid_region(F.col(id_col)))


def domain_points(facilities: DataFrame, basin_edges: DataFrame) -> DataFrame:
    """Facilities projected to EPSG:5070 and kept where they fall inside a basin."""
    return domain_filter(project_points(facilities), project_edges(basin_edges), "x", "y")


def regional_shares(
    facilities: DataFrame, basin_edges: DataFrame, region_edges: DataFrame, assigned_total: bool = False,
) -> DataFrame:
    """Count, percent and class per sector and region; the total is all domain points unless ``assigned_total``."""
    regions = padded_regions(region_edges)
    inside = cut(domain_points(facilities, basin_edges).select("sector", "x", "y"), "domain-points")  # for shares and totals
    located = points_in_polygons(inside, project_edges(regions), "inner", "x", "y", "huc2")
    totals = None if assigned_total else inside.groupBy("sector").agg(F.count(F.lit(1)).alias("total"))
    return region_shares(regions, located, totals)


def label_candidates(shares: DataFrame, min_pct: float = 3.0, n: int = 40) -> DataFrame:
    return top_shares(shares, min_pct, n)


def filter_report(facilities: DataFrame, inside: DataFrame) -> DataFrame:
    """Facilities per sector before and after the domain filter."""
    before = facilities.groupBy("sector").agg(F.count(F.lit(1)).alias("before"))
    after = inside.groupBy("sector").agg(F.count(F.lit(1)).alias("after"))
    return before.join(after, "sector", "left").withColumn("after", F.coalesce("after", F.lit(0)).cast("bigint"))


def run(spark: SparkSession, points: dict[str, str], basin_edges: str, region_edges: str, out: str) -> dict[str, DataFrame]:
    """Whole analysis from input paths."""
    check_inputs(spark, [*points.values(), basin_edges, region_edges])
    basins, regions = clean_edges(read_table(spark, basin_edges), "basin_id"), clean_edges(read_table(spark, region_edges), "huc2")
    sites = cut(union_parts(*[load_points(spark, path, s).select("sector", "lon", "lat") for s, path in points.items()]), "sites")
    shares = cut(regional_shares(sites, basins, regions), "shares")
    tables = {"shares": shares, "labels": label_candidates(shares), "filter_report": filter_report(sites, domain_points(sites, basins))}
    for name, table in tables.items():
        write_csv(table, f"{out}/{name}")
    return tables
