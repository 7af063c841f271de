"""Counts, shares, bins, joins and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catchmark.catalog import Query
from catchmark.catalog.common import (
    BINNED, CUTS, FAC_CTES, FAC_INPUT, HIT, MASTER, MASTER_INPUT, PRESENCE, PRESENCE_INPUT,
    SECTORS, STRESS_INPUT, STRESS_JOIN, R, binned, facilities_with_stress, fx, inside_sql, located, master, num, out,
    presence, projected_edges_sql, projected_points_sql, r6, sql,
)
from catchmark.catalog.locating import REF_CTES, REF_INPUT, reference
from catchmark.functions import clean
from catchmark.operators import tables as tb
from catchmark.operators.distributions import axis_limits, descriptives, histogram, summary_counts
from catchmark.operators.ordered import exact_quantiles
from catchmark.plans import distance as dist_plan
from catchmark.plans import regimes as regime_plan
from catchmark.plans import regions as region_plan

QUERIES: dict[str, Query] = {}

QUERIES["presence_counts"] = Query(
    lambda spark, d: presence(spark, d).select(
        "basin_id", r6("area_km2").alias("area_km2"), *[f"n_{s}" for s in SECTORS], *[f"{s}_present" for s in SECTORS]
    ),
    sql(PRESENCE_INPUT, f"SELECT basin_id, {R('area_km2')} AS area_km2, n_AI, n_Power, n_TRI, AI_present, Power_present, TRI_present FROM presence", HIT, PRESENCE),
)
QUERIES["basin_counts"] = Query(
    lambda spark, d: tb.presence_counts(located(spark, d)),
    sql(["facilities", "basin_edges"], "SELECT basin_id, sector, count(*) AS n, 1 AS present FROM hit GROUP BY basin_id, sector", HIT),
)

# --- regional shares (all in projected coordinates) -----------------------------------------------------------
REGION_CTES = (
    ("pts", projected_points_sql("facilities", "sector, site_id")),
    ("edges_m", projected_edges_sql("basin_edges", "basin_id, ring")),
    ("redges", projected_edges_sql("region_edges WHERE huc2 NOT IN ('19', '20', '21', '22')", "huc2")),
    ("dom", inside_sql("pts", "edges_m", "p.sector, p.site_id, p.x, p.y, e.basin_id", "p.sector, p.site_id, p.x, p.y, e.basin_id", "x", "y")),
    ("rin", inside_sql("dom", "redges", "p.sector, p.site_id, e.huc2", "p.sector, p.site_id, e.huc2", "x", "y")),
    ("tot", "SELECT sector, count(*) AS total FROM dom GROUP BY sector"),
    (
        "shares",
        "SELECT *, 100e0 * n / total AS pct FROM (SELECT t.sector, r.huc2, t.total, (SELECT count(*) FROM rin WHERE rin.sector = t.sector AND rin.huc2 = r.huc2) AS n "
        "FROM tot AS t CROSS JOIN (SELECT DISTINCT huc2 FROM redges) AS r) AS g",
    ),
)
REGION_INPUT = ("facilities", "basin_edges", "region_edges")
_CLASS = (
    "CASE WHEN pct = 0 THEN '0%' WHEN pct <= 0.000001 THEN '0%' WHEN pct <= 1 THEN '0–1%' WHEN pct <= 3 THEN '1–3%' WHEN pct <= 6 THEN '3–6%' "
    "WHEN pct <= 10 THEN '6–10%' WHEN pct <= 100 THEN '>10%' ELSE 'nan' END"
)


def _shares(spark, d):
    return region_plan.regional_shares(
        fx(spark, d, "facilities"), fx(spark, d, "basin_edges"), fx(spark, d, "region_edges")
    )


QUERIES["region_share"] = Query(
    lambda spark, d: _shares(spark, d).select("sector", "huc2", F.col("count").alias("n"), "total", r6("pct").alias("pct"), "class"),
    sql(REGION_INPUT, f'SELECT sector, huc2, n, total, {R("pct")} AS pct, {_CLASS} AS "class" FROM shares', *REGION_CTES),
)
QUERIES["region_top"] = Query(
    lambda spark, d: region_plan.label_candidates(_shares(spark, d)).select("sector", "huc2", r6("pct").alias("pct"), F.col("rank").cast("bigint").alias("rank")),
    sql(
        REGION_INPUT,
        f"SELECT sector, huc2, {R('pct')} AS pct, rank FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY pct DESC, huc2) AS rank FROM shares WHERE pct >= 3) AS t WHERE rank <= 40",
        *REGION_CTES,
    ),
)


def filter_report(spark, d):
    fac = fx(spark, d, "facilities")
    return region_plan.filter_report(fac, region_plan.domain_points(fac, fx(spark, d, "basin_edges")))


QUERIES["filter_report"] = Query(
    filter_report,
    sql(
        ["facilities", "basin_edges"],
        "SELECT sector, count(*) AS before, (SELECT count(*) FROM dom WHERE dom.sector = f.sector) AS after FROM facilities AS f GROUP BY sector",
        *REGION_CTES[:2], REGION_CTES[3],
    ),
)

# --- stress classes -------------------------------------------------------------------------------------------
_PCT = ", ".join(f"{R(f'100e0 * {n} / total')} AS {n}_percent" for n in ("Low", "Medium", "High"))
_LMH = (
    "SELECT sector, count(*) FILTER (WHERE stress_tertile = 'low') AS Low, count(*) FILTER (WHERE stress_tertile = 'medium') AS Medium, "
    "count(*) FILTER (WHERE stress_tertile = 'high') AS High, count(*) AS total FROM fac GROUP BY sector"
)
QUERIES["sector_class_pct"] = Query(
    lambda spark, d: out(tb.class_percents(facilities_with_stress(spark, d)), "sector", "Low", "Medium", "High", "Not_high", "Total"),
    sql(FAC_INPUT, f'SELECT sector, Low, Medium, High, Low + Medium AS Not_high, total AS "Total", {_PCT} FROM ({_LMH}) AS t', *FAC_CTES),
)


def class_props(spark, d):
    fac = facilities_with_stress(spark, d).select("sector", "stress_quartile")
    both = fac.unionByName(reference(spark, d).select("sector", "stress_quartile"))
    counts = tb.class_counts(both, ["sector"], {"stress_quartile": tb.QUARTILES})
    return tb.class_proportions(counts, ["sector"]).select("sector", "class", F.col("n").cast("bigint").alias("n"), r6("share").alias("share"))


QUERIES["class_props"] = Query(
    class_props,
    sql(
        REF_INPUT,
        f'SELECT sector, q AS "class", n, {R("n / greatest(1, sum(n) OVER (PARTITION BY sector))")} AS share FROM ('
        "SELECT g.sector, c.q, (SELECT count(*) FROM both_sides AS b WHERE b.sector = g.sector AND b.stress_quartile = c.q) AS n "
        "FROM (SELECT DISTINCT sector FROM both_sides) AS g CROSS JOIN (VALUES ('Q1'), ('Q2'), ('Q3'), ('Q4')) AS c(q)) AS t",
        *FAC_CTES, *REF_CTES,
        ("both_sides", "SELECT sector, stress_quartile FROM fac UNION ALL SELECT 'Reference', stress_quartile FROM ref"),
    ),
)
QUERIES["stress_join"] = Query(
    lambda spark, d: tb.attach_stress(fx(spark, d, "basins"), fx(spark, d, "stress")).select("basin_id", "pfaf6", r6("stress_value").alias("stress_value")),
    sql(STRESS_INPUT, f"SELECT basin_id, pfaf6, {R('stress_value')} AS stress_value FROM bas", STRESS_JOIN),
)
QUERIES["stress_join_fanout"] = Query(
    lambda spark, d: tb.attach_stress(fx(spark, d, "basins"), fx(spark, d, "stress"), dedupe=False).select("basin_id", "pfaf6", r6("stress_value").alias("stress_value")),
    sql(STRESS_INPUT, f"SELECT b.basin_id, b.pfaf_id // 100 AS pfaf6, {R('s.bws_raw')} AS stress_value FROM basins AS b LEFT JOIN stress AS s ON s.pfaf_id = b.pfaf_id // 100"),
)
QUERIES["cutpoints"] = Query(
    lambda spark, d: out(tb.cut_points(tb.attach_stress(fx(spark, d, "basins"), fx(spark, d, "stress")))),
    sql(STRESS_INPUT, "SELECT " + ", ".join(f"{R(c)} AS {c}" for c in ("t1", "t2", "q1", "q2", "q3")) + " FROM cuts", STRESS_JOIN, CUTS),
)
QUERIES["tertiles"] = Query(
    lambda spark, d: binned(spark, d).select("basin_id", "stress_tertile"),
    sql(STRESS_INPUT, "SELECT basin_id, stress_tertile FROM binned", STRESS_JOIN, CUTS, BINNED),
)
QUERIES["quartiles"] = Query(
    lambda spark, d: binned(spark, d).select("basin_id", "stress_quartile"),
    sql(STRESS_INPUT, "SELECT basin_id, stress_quartile FROM binned", STRESS_JOIN, CUTS, BINNED),
)

# --- master ---------------------------------------------------------------------------------------------------
_MCOLS = ("meanQ", "CVQ", "RBI", "season_conc", "Q10", "Q90")


def _master_rows(how):
    def run(spark, d):
        m = master(spark, d, how)
        return m.select("basin_id", "any_infra", "group_excl", *[r6(c).alias(c) for c in _MCOLS])

    return run


_MSEL = "p.basin_id, CASE WHEN n_AI + n_Power + n_TRI > 0 THEN 1 ELSE 0 END AS any_infra, CASE WHEN n_AI + n_Power + n_TRI > 0 THEN 'Infrastructure' ELSE 'None' END AS group_excl, "
_MSEL += ", ".join(f"{R(c)} AS {c}" for c in _MCOLS)
QUERIES["master_inner"] = Query(
    _master_rows("inner"),
    sql(
        MASTER_INPUT,
        f"SELECT {_MSEL} FROM presence AS p JOIN basin_metrics_fx AS m ON m.basin_id = p.basin_id WHERE RBI IS NOT NULL AND season_conc IS NOT NULL AND CVQ IS NOT NULL",
        HIT, PRESENCE,
    ),
)
QUERIES["master_left"] = Query(
    _master_rows("left"),
    sql(MASTER_INPUT, f"SELECT {_MSEL} FROM presence AS p LEFT JOIN basin_metrics_fx AS m ON m.basin_id = p.basin_id", HIT, PRESENCE),
)


def group_counts(spark, d):
    m = master(spark, d)
    return m.agg(
        F.count(F.lit(1)).alias("n_valid"), F.count_if(F.col("group_excl") == "None").alias("n_none"),
        *[F.sum(F.col(f"{s}_present")).alias(f"n_{s}") for s in SECTORS],
    )


QUERIES["group_counts"] = Query(
    group_counts,
    sql(
        MASTER_INPUT,
        "SELECT count(*) AS n_valid, count(*) FILTER (WHERE any_infra = 0) AS n_none, "
        + ", ".join(f'cast(sum({s}_present) as bigint) AS "n_{s}"' for s in SECTORS)
        + " FROM master",
        HIT, PRESENCE, MASTER,
    ),
)


def union_parts(spark, d):
    fac = fx(spark, d, "facilities")
    parts = [fac.filter(F.col("sector") == s).drop("site_id") if s == "TRI" else fac.filter(F.col("sector") == s) for s in SECTORS]
    return tb.union_parts(*parts).groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.count("site_id").alias("n_ids"))


QUERIES["union_parts"] = Query(
    union_parts,
    sql(["facilities"], "SELECT sector, count(*) AS n, count(CASE WHEN sector <> 'TRI' THEN site_id END) AS n_ids FROM facilities GROUP BY sector"),
)

# --- descriptives ---------------------------------------------------------------------------------------------
_POS = "dist_river_km IS NOT NULL AND dist_river_km > 0"


def wide_desc(spark, d):
    return out(dist_plan.wide_descriptives(fx(spark, d, "distances"), "dist_river_km"), "sector", "n_sector", "n_random")


def _half(g: str) -> str:
    return (
        f"SELECT sector, count(*) AS n_{g}, {R('median(dist_river_km)')} AS median_{g}, {R('quantile_cont(dist_river_km, 0.25)')} AS q1_{g}, "
        f"{R('quantile_cont(dist_river_km, 0.75)')} AS q3_{g}, {R('avg(dist_river_km)')} AS mean_{g} FROM distances WHERE grp = '{g}' AND {_POS} GROUP BY sector"
    )


QUERIES["wide_desc"] = Query(
    wide_desc,
    sql(["distances"], f"SELECT a.*, b.* EXCLUDE (sector) FROM ({_half('sector')}) AS a LEFT JOIN ({_half('random')}) AS b ON b.sector = a.sector"),
)


def dist_summary(spark, d):
    from catchmark.sources.readers import clean_distances

    cols = ("dist_river_km", "dist_lake_km", "dist_coast_km", "dist_any_km")
    dist = clean_distances(fx(spark, d, "distances")).select("sector", "grp", *cols)
    return out(summary_counts(dist, ["sector", "grp"], cols), "sector", "grp", "n")


QUERIES["dist_summary"] = Query(
    dist_summary,
    sql(
        ["distances"],
        "SELECT sector, grp, count(*) AS n, "
        + ", ".join(f"{R(f'median({c})')} AS median_{c}" for c in ("dist_river_km", "dist_lake_km", "dist_coast_km", "dist_any_km"))
        + " FROM (SELECT *, least(dist_river_km, dist_lake_km, dist_coast_km) AS dist_any_km FROM distances) AS t GROUP BY sector, grp",
    ),
)
QUERIES["descriptives"] = Query(
    lambda spark, d: out(descriptives(clean.keep_values(fx(spark, d, "distances"), "dist_lake_km"), ["sector", "grp"], "dist_lake_km"), "sector", "grp", "n"),
    sql(
        ["distances"],
        f"SELECT sector, grp, count(*) AS n, {R('avg(dist_lake_km)')} AS mean, {R('quantile_cont(dist_lake_km, 0.25)')} AS q1, {R('median(dist_lake_km)')} AS median, "
        f"{R('quantile_cont(dist_lake_km, 0.75)')} AS q3 FROM distances WHERE dist_lake_km >= 0 GROUP BY sector, grp",
    ),
)


def exact_cuts(spark, d):
    flow = fx(spark, d, "streamflow").withColumn("v", F.col("q") * F.dayofyear("time"))
    got = exact_quantiles(flow, [], "v", {"p01": 0.01, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p995": 0.995})
    return out(got)


QUERIES["exact_quantiles"] = Query(
    exact_cuts,
    sql(
        ["streamflow"],
        "SELECT " + ", ".join(f"{R(f'quantile_cont(v, {p})')} AS {n}" for n, p in (("p01", 0.01), ("p10", 0.1), ("p50", 0.5), ("p90", 0.9), ("p995", 0.995)))
        + " FROM (SELECT q * dayofyear(time) AS v FROM streamflow) AS t",
    ),
)


def median_iqr(spark, d):
    return regime_plan.median_iqr_table(master(spark, d, "left"))


_GROUPS = {"AI": "AI_present = 1", "Non-AI": "AI_present = 0", "Power": "Power_present = 1", "TRI": "TRI_present = 1"}


def _iqr_sql() -> str:
    rows = []
    for m in regime_plan.TABLE_METRICS:
        cells = []
        for g, cond in _GROUPS.items():
            q = lambda p: f"quantile_cont({m}, {p}) FILTER (WHERE {cond})"  # noqa: E731,B023
            cells.append(f"coalesce(printf('%.3f [%.3f, %.3f]', {q(0.5)}, {q(0.25)}, {q(0.75)}), '') AS \"{g} basins\"")
        rows.append(f"SELECT '{m}' AS \"Metric\", {', '.join(cells)} FROM presence AS p LEFT JOIN basin_metrics_fx AS m ON m.basin_id = p.basin_id")
    return " UNION ALL ".join(rows)


QUERIES["median_iqr"] = Query(median_iqr, sql(MASTER_INPUT, _iqr_sql(), HIT, PRESENCE))


def limits(spark, d):
    dist = fx(spark, d, "distances").unpivot(["sector", "grp"], ["dist_river_km", "dist_lake_km", "dist_coast_km"], "kind", "x")
    return out(axis_limits(dist.filter("x > 0"), ["kind"], "x", 0.001, 0.995, 0.1, 10.0), "kind")


QUERIES["axis_limits"] = Query(
    limits,
    sql(
        ["distances"],
        " UNION ALL ".join(
            f"SELECT '{c}' AS kind, {R('lo')} AS lo, {R('greatest(hi, lo * 10)')} AS hi FROM (SELECT greatest(quantile_cont({c}, 0.001), 0.1) AS lo, "
            f"quantile_cont({c}, 0.995) AS hi FROM distances WHERE {c} > 0) AS t"
            for c in ("dist_river_km", "dist_lake_km", "dist_coast_km")
        ),
    ),
)
_BIN = "least(cast(floor((v - lo) * 40e0 / (hi - lo)) as bigint), 39)"
QUERIES["hist40"] = Query(
    lambda spark, d: histogram(fx(spark, d, "streamflow").withColumn("v", F.col("q") * F.dayofyear("time")), "v").select(
        F.col("bin").cast("bigint").alias("bin"), r6("left_edge").alias("left_edge"), r6("right_edge").alias("right_edge"), "n"
    ),
    sql(
        ["streamflow"],
        f"SELECT bin, {R('lo + bin * (hi - lo) / 40e0')} AS left_edge, {R('lo + (bin + 1) * (hi - lo) / 40e0')} AS right_edge, (SELECT count(*) FROM vals AS w WHERE "
        f"{_BIN} = g.bin) AS n FROM (SELECT unnest(range(0, 40)) AS bin) AS g CROSS JOIN lim",
        ("lim", "SELECT min(q * dayofyear(time)) AS lo, max(q * dayofyear(time)) AS hi FROM streamflow"),
        ("vals", "SELECT q * dayofyear(time) AS v, lo, hi FROM streamflow CROSS JOIN lim"),
    ),
)
