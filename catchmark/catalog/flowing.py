"""Streamflow metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catchmark.catalog import Query
from catchmark.catalog.common import R, fx, out, r6, sql
from catchmark.catalog.locating import REACH_HIT, REACH_MAP
from catchmark.operators import hydrology as hy
from catchmark.operators.lineage import cut
from catchmark.operators.polygons import reach_map
from catchmark.plans.regimes import reach_metrics

QUERIES: dict[str, Query] = {}


def daily_mean(spark, d):
    got = hy.daily_mean(fx(spark, d, "hourly"))
    return got.select("feature_id", F.col("day").cast("string").alias("day"), r6("q").alias("q"))


QUERIES["daily_mean"] = Query(
    daily_mean,
    sql(["hourly"], f"SELECT feature_id, cast(cast(time as date) as varchar) AS day, {R('avg(q)')} AS q FROM hourly GROUP BY 1, 2"),
)
DAILY = ("daily", "SELECT feature_id, cast(time as date) AS day, avg(q) AS q FROM streamflow GROUP BY 1, 2")
STEPS = (
    "steps",
    "SELECT *, CASE WHEN lag(day) OVER w = day - 1 THEN abs(q - lag(q) OVER w) END AS dq FROM daily WINDOW w AS (PARTITION BY feature_id ORDER BY day)",
)
CLIM = ("clim", "SELECT feature_id, month(day) AS m, avg(q) AS q FROM daily GROUP BY 1, 2")
RANKED = ("ranked", "SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY q DESC) AS rk, count(*) OVER (PARTITION BY feature_id) AS have FROM clim")
SEASON = ("season", "SELECT feature_id, sum(CASE WHEN rk <= 3 - (12 - have) THEN q ELSE 0 END) / nullif(sum(q), 0) AS season_conc FROM ranked GROUP BY 1")
FLOW = (
    "flow",
    "SELECT feature_id, avg(q) AS meanQ, stddev_pop(q) AS stdQ, stddev_pop(q) / nullif(avg(q), 0) AS CVQ, quantile_cont(q, 0.1) AS Q10, "
    "quantile_cont(q, 0.9) AS Q90, coalesce(sum(dq), 0) / nullif(sum(q), 0) AS RBI FROM steps GROUP BY 1",
)
METRIC_CTES = (DAILY, STEPS, CLIM, RANKED, SEASON, FLOW)


def _metrics(spark, d):
    return hy.regime_metrics(hy.daily_mean(fx(spark, d, "streamflow")))


QUERIES["flow_stats"] = Query(
    lambda spark, d: out(_metrics(spark, d).select("feature_id", "meanQ", "stdQ", "CVQ", "Q10", "Q90"), "feature_id"),
    sql(["streamflow"], "SELECT feature_id, " + ", ".join(f"{R(c)} AS {c}" for c in ("meanQ", "stdQ", "CVQ", "Q10", "Q90")) + " FROM flow", DAILY, STEPS, FLOW),
)
QUERIES["season_conc"] = Query(
    lambda spark, d: out(_metrics(spark, d).select("feature_id", "season_conc"), "feature_id"),
    sql(["streamflow"], f"SELECT feature_id, {R('season_conc')} AS season_conc FROM season", DAILY, CLIM, RANKED, SEASON),
)
QUERIES["rbi"] = Query(
    lambda spark, d: out(_metrics(spark, d).select("feature_id", "RBI"), "feature_id"),
    sql(["streamflow"], f"SELECT feature_id, {R('RBI')} AS RBI FROM flow", DAILY, STEPS, FLOW),
)


def event_regimes(spark, d):
    """The same metrics on the densely sampled event stream, whose days do follow one another (one calendar month)."""
    return out(hy.regime_metrics(hy.daily_mean(fx(spark, d, "hourly")), months=1), "feature_id")


QUERIES["event_regimes"] = Query(
    event_regimes,
    sql(
        ["hourly"],
        "SELECT f.feature_id, " + ", ".join(f"{R(c)} AS {c}" for c in ("meanQ", "stdQ", "CVQ", "Q10", "Q90", "RBI"))
        + f", {R('1e0')} AS season_conc FROM flow AS f",
        ("daily", DAILY[1].replace("streamflow", "hourly")), STEPS, FLOW,
    ),
)


def _top(spark, d):
    return hy.top_reaches(reach_map(fx(spark, d, "reaches"), fx(spark, d, "basin_edges")))


TOP = ("top", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY basin_id ORDER BY ord DESC NULLS LAST, feature_id) AS rk FROM rmap) AS t WHERE rk = 1")
QUERIES["top_reach"] = Query(
    lambda spark, d: _top(spark, d).select("basin_id", "feature_id", F.col("ord").cast("bigint").alias("ord")),
    sql(["reaches", "basin_edges"], "SELECT basin_id, feature_id, cast(ord as bigint) AS ord FROM top", REACH_HIT, REACH_MAP, TOP),
)


def basin_metrics(spark, d):
    top = cut(_top(spark, d), "top-reaches")  # selects the reaches and names their basins
    got = hy.basin_metrics(reach_metrics(fx(spark, d, "streamflow"), top, "1995-01-01", "2001-12-31"), top)
    return out(got, "basin_id")


QUERIES["basin_metrics"] = Query(
    basin_metrics,
    sql(
        ["reaches", "basin_edges", "streamflow"],
        "SELECT t.basin_id, " + ", ".join(f"{R(f'avg({c})')} AS {c}" for c in hy.METRICS)
        + " FROM top AS t JOIN flow AS f ON f.feature_id = t.feature_id JOIN season AS s ON s.feature_id = t.feature_id GROUP BY t.basin_id",
        REACH_HIT, REACH_MAP, TOP, *METRIC_CTES,
    ),
)
