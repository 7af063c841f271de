"""Loading, cleaning, labelling and formatting."""

from __future__ import annotations

from pyspark.sql import functions as F

from catchmark.catalog import Query
from catchmark.catalog.common import (
    noise_u,
    HIT, PRESENCE, PRESENCE_INPUT, SECTORS, R, fx, out, presence, r6, sql,
)
from catchmark.fixtures import PATHWAY_NAMES, u
from catchmark.functions import clean, text
from catchmark.functions.random import hashed_uniform
from catchmark.operators import tables as tb
from catchmark.operators.hydrology import flow_window
from catchmark.sources import readers

QUERIES: dict[str, Query] = {}


def points_clean(spark, d):
    raw = fx(spark, d, "facilities_raw").withColumnsRenamed({"lon_text": " Longitude ", "lat_text": "Latitude"})
    parts = [readers.clean_points(raw.filter(F.col("sector") == s), s) for s in SECTORS]
    return tb.union_parts(*parts).select("sector", "site_id", r6("lon").alias("lon"), r6("lat").alias("lat"))


QUERIES["points_clean"] = Query(
    points_clean,
    sql(
        ["facilities_raw"],
        f"SELECT sector, site_id, {R('lon')} AS lon, {R('lat')} AS lat FROM (SELECT sector, site_id, try_cast(trim(lon_text) as double) AS lon, "
        "try_cast(trim(lat_text) as double) AS lat FROM facilities_raw) AS t WHERE lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat)",
    ),
)


def segments_clean(spark, d):
    raw = fx(spark, d, "water_segments").withColumn("ORD_STRA", F.col("ord").cast("string")).drop("ord")
    return readers.clean_segments(raw).select(
        "kind", "feature_id", F.col("ord").cast("bigint").alias("ord"), *[r6(c).alias(c) for c in ("x1", "y1", "x2", "y2")]
    )


QUERIES["segments_clean"] = Query(
    segments_clean,
    sql(
        ["water_segments"],
        "SELECT kind, cast(feature_id as bigint) AS feature_id, cast(ord as bigint) AS ord, "
        + ", ".join(f"{R(c)} AS {c}" for c in ("x1", "y1", "x2", "y2"))
        + " FROM water_segments WHERE x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL",
    ),
)


def dist_values(spark, d):
    dist = fx(spark, d, "distances")
    variants = {"all": (None, False), "from_zero": (0.0, False), "above_zero": (0.0, True)}
    parts = [clean.keep_values(dist, "dist_river_km", lo, strict).withColumn("variant", F.lit(v)) for v, (lo, strict) in variants.items()]
    return tb.union_parts(*parts).groupBy("variant", "sector", "grp").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("dist_river_km"), 3).alias("total")
    )


QUERIES["dist_values"] = Query(
    dist_values,
    sql(
        ["distances"],
        f"SELECT v AS variant, sector, grp, count(*) AS n, {R('sum(dist_river_km)', 3)} AS total FROM distances "
        "CROSS JOIN (VALUES ('all'), ('from_zero'), ('above_zero')) AS t(v) WHERE dist_river_km IS NOT NULL AND (v = 'all' OR dist_river_km > 0 OR "
        "(v = 'from_zero' AND dist_river_km = 0)) GROUP BY v, sector, grp",
    ),
)

METRIC_COLS = ("meanQ", "CVQ", "RBI", "season_conc", "Q10", "Q90")
QUERIES["master_valid"] = Query(
    lambda spark, d: out(readers.valid_master(fx(spark, d, "basin_metrics_fx")), "basin_id"),
    sql(["basin_metrics_fx"], "SELECT basin_id, " + ", ".join(f"{R(c)} AS {c}" for c in METRIC_COLS) + " FROM basin_metrics_fx WHERE meanQ IS NOT NULL"),
)


def units_logs(spark, d):
    v = F.col("dist_river_km")
    return fx(spark, d, "distances").select(
        "sector", "grp", "site_id", r6(v / 1000.0).alias("km"), r6(F.log(v + 1.0)).alias("log_dist"), r6(F.exp(-v / 100.0)).alias("decay")
    )


QUERIES["units_logs"] = Query(
    units_logs,
    sql(
        ["distances"],
        f"SELECT sector, grp, site_id, {R('dist_river_km / 1e3')} AS km, {R('ln(dist_river_km + 1e0)')} AS log_dist, "
        f"{R('exp(-dist_river_km / 1e2)')} AS decay FROM distances",
    ),
)

QUERIES["distinct_keys"] = Query(
    lambda spark, d: fx(spark, d, "streamflow").select("feature_id").distinct(),
    sql(["streamflow"], "SELECT DISTINCT feature_id FROM streamflow"),
)


def format_cells(spark, d):
    v, lo, hi = F.col("dist_river_km"), F.col("dist_lake_km"), F.col("dist_coast_km")
    p = F.when(F.col("site_id") % 37 == 0, F.lit(0.0)).otherwise(F.round(F.pow(hashed_uniform(F.col("site_id"), 77), 6.0), 6))
    return fx(spark, d, "distances").select(
        "sector", "grp", "site_id",
        text.fmt_num(v * 20.0, 2).alias("num_cell"), text.fmt_p(p).alias("p_cell"),
        text.fmt_median_iqr(v, lo, hi).alias("iqr_cell"), text.fmt_range(lo, hi).alias("range_cell"),
    )


_P = f"(CASE WHEN site_id % 37 = 0 THEN 0e0 ELSE round(pow({noise_u('site_id', 77)}, 6e0), 6) END)"
_NUM = lambda v: f"(CASE WHEN {v} IS NULL THEN '' WHEN abs({v}) >= 1000 THEN format('{{:,.0f}}', {v}) ELSE printf('%.2f', {v}) END)"
QUERIES["format_cells"] = Query(
    format_cells,
    sql(
        ["distances"],
        f"SELECT sector, grp, site_id, {_NUM('(dist_river_km * 20e0)')} AS num_cell, "
        f"CASE WHEN {_P} = 0 THEN '<1e-4' WHEN {_P} < 1e-4 THEN cast({_P} as varchar) WHEN {_P} < 1e-3 THEN '<0.001' ELSE printf('%.3f', {_P}) END AS p_cell, "
        "CASE WHEN dist_river_km IS NULL THEN '' ELSE printf('%.3f', dist_river_km) || ' [' || printf('%.3f', dist_lake_km) || ', ' || printf('%.3f', dist_coast_km) || ']' END AS iqr_cell, "
        f"{_NUM('dist_lake_km')} || '–' || {_NUM('dist_coast_km')} AS range_cell FROM distances",
    ),
)


def short_headers(spark, d):
    table = fx(spark, d, "distances").groupBy(F.col("sector").alias("Sector"), F.col("grp").alias("Metric")).agg(
        F.count(F.lit(1)).alias("N_sector"), r6(F.min("dist_lake_km")).alias("CI95_low"), r6(F.max("dist_lake_km")).alias("CI95_high"),
        r6(F.avg("dist_lake_km")).alias("MedianDiff_sector_minus_none"),
    )
    return tb.short_headers(table).orderBy("Sector", "Metric")


QUERIES["short_headers"] = Query(
    short_headers,
    sql(
        ["distances"],
        f'SELECT grp AS "Metric", sector AS "Sector", count(*) AS "N", {R("min(dist_lake_km)")} AS "CI95 low", {R("max(dist_lake_km)")} AS "CI95 high", '
        f'{R("avg(dist_lake_km)")} AS "MedianΔ" FROM distances GROUP BY sector, grp ORDER BY 2, 1',
    ),
)

QUERIES["stress_dedup"] = Query(
    lambda spark, d: out(tb.dedupe_stress(readers.clean_stress(fx(spark, d, "stress"))), "pfaf_id"),
    sql(["stress"], f"SELECT pfaf_id, {R('min(bws_raw)')} AS bws_raw FROM stress WHERE pfaf_id <> -9999 GROUP BY pfaf_id"),
)
QUERIES["pfaf_parent"] = Query(
    lambda spark, d: fx(spark, d, "basins").select("basin_id", clean.parent_key(F.col("pfaf_id")).alias("pfaf6")),
    sql(["basins"], "SELECT basin_id, pfaf_id // 100 AS pfaf6 FROM basins"),
)
QUERIES["dist_any"] = Query(
    lambda spark, d: readers.clean_distances(fx(spark, d, "distances")).select("sector", "grp", "site_id", r6("dist_any_km").alias("dist_any_km")),
    sql(["distances"], f"SELECT sector, grp, site_id, {R('least(dist_river_km, dist_lake_km, dist_coast_km)')} AS dist_any_km FROM distances"),
)


def nearest_kind_tie(spark, d):
    dist = fx(spark, d, "distances")
    kinds = {"River": F.col("dist_river_km"), "Lake": F.col("dist_lake_km"), "Coast": F.col("dist_coast_km")}
    return dist.select("sector", "grp", "site_id", clean.nearest_kind(kinds).alias("nearest"))


_LEAST = "least(dist_river_km, dist_lake_km, dist_coast_km)"
QUERIES["nearest_kind_tie"] = Query(
    nearest_kind_tie,
    sql(
        ["distances"],
        f"SELECT sector, grp, site_id, CASE WHEN dist_river_km = {_LEAST} THEN 'River' WHEN dist_lake_km = {_LEAST} THEN 'Lake' "
        f"WHEN dist_coast_km = {_LEAST} THEN 'Coast' END AS nearest FROM distances",
    ),
)


def region_ids(spark, d):
    raw = spark.read.parquet(f"{d}/customer.parquet").withColumn("huc2", (F.col("c_nationkey") + 1).cast("string"))
    padded = raw.withColumn("huc2", clean.zfill(F.col("huc2"), 2)).filter(clean.valid_region(F.col("huc2")))
    return padded.select("c_custkey", "huc2")


QUERIES["region_ids"] = Query(
    region_ids,
    "SELECT c_custkey, lpad(cast(c_nationkey + 1 as varchar), 2, '0') AS huc2 FROM customer WHERE c_nationkey + 1 NOT IN (19, 20, 21, 22)",
)
QUERIES["river_order"] = Query(
    lambda spark, d: readers.major_rivers(fx(spark, d, "water_segments")).select("feature_id", F.col("ord").cast("bigint").alias("ord")),
    sql(["rivers"], "SELECT feature_id, cast(ord as bigint) AS ord FROM rivers WHERE ord >= 5"),
)


def streamflow_window(spark, d):
    reaches = fx(spark, d, "reaches").filter("ord >= 5")
    flow = flow_window(fx(spark, d, "streamflow"), "1996-03-01", "1998-09-30", reaches)
    return flow.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("q")).alias("total"), F.max("time").cast("date").cast("string").alias("last_day"))


QUERIES["streamflow_window"] = Query(
    streamflow_window,
    sql(
        ["streamflow", "reaches"],
        f"SELECT feature_id, count(*) AS n, {R('sum(q)')} AS total, cast(cast(max(time) as date) as varchar) AS last_day FROM streamflow "
        "WHERE time >= timestamp '1996-03-01' AND time < timestamp '1998-10-01' AND feature_id IN (SELECT feature_id FROM reaches WHERE ord >= 5) GROUP BY feature_id",
    ),
)


def exclusive_group(spark, d):
    return presence(spark, d).select("basin_id", clean.exclusive_group(*[F.col(f"{s}_present") for s in SECTORS]).alias("group_excl"))


QUERIES["exclusive_group"] = Query(
    exclusive_group,
    sql(
        PRESENCE_INPUT,
        "SELECT basin_id, CASE WHEN AI_present = 1 THEN 'AI' WHEN Power_present = 1 THEN 'Power' WHEN TRI_present = 1 THEN 'TRI' ELSE 'None' END AS group_excl FROM presence",
        HIT, PRESENCE,
    ),
)
QUERIES["overlap_groups"] = Query(
    lambda spark, d: tb.overlapping_groups(presence(spark, d), with_non_ai=True).select("basin_id", F.col("group").alias("grp")),
    sql(
        PRESENCE_INPUT,
        "SELECT basin_id, 'AI' AS grp FROM presence WHERE AI_present = 1 UNION ALL SELECT basin_id, 'Power' FROM presence WHERE Power_present = 1 "
        "UNION ALL SELECT basin_id, 'TRI' FROM presence WHERE TRI_present = 1 UNION ALL SELECT basin_id, 'Non-AI' FROM presence WHERE AI_present = 0 "
        "UNION ALL SELECT basin_id, 'None' FROM presence WHERE AI_present + Power_present + TRI_present = 0",
        HIT, PRESENCE,
    ),
)


def effect_words(spark, d):
    v = F.col("v")
    frame = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", hashed_uniform(F.col("o_orderkey"), 55).alias("v"))
    return frame.select("o_orderkey", clean.effect_word(v).alias("effect"), clean.significant(v).cast("int").alias("significant"))


_V = noise_u("o_orderkey", 55)
QUERIES["effect_words"] = Query(
    effect_words,
    f"SELECT o_orderkey, CASE WHEN {_V} < 0.1 THEN 'very small' WHEN {_V} < 0.3 THEN 'small' WHEN {_V} < 0.5 THEN 'moderate' ELSE 'large' END AS effect, "
    f"CASE WHEN {_V} < 0.05 THEN 1 ELSE 0 END AS significant FROM orders",
)

QUERIES["pathways_long"] = Query(
    lambda spark, d: readers.select_pathways(fx(spark, d, "pathways")).select("sector", "pathway", "pos", r6("percent").alias("percent")),
    sql(
        ["pathways"],
        " UNION ALL ".join(
            f"SELECT sector, '{name}' AS pathway, {n + 1} AS pos, {R(chr(34) + name + chr(34))} AS percent FROM pathways" for n, name in enumerate(PATHWAY_NAMES)
        ),
    ),
)
