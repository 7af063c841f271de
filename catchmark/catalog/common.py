"""Shared pieces of the registered queries: fixture inputs for Spark and the matching SQL for the oracle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catchmark import fixtures
from catchmark.operators import tables as tb
from catchmark.operators.polygons import points_in_polygons
from catchmark.plans import stress as stress_plan

SECTORS = ("AI", "Power", "TRI")


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fixtures.view(spark, sf_dir, name)


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def out(df: DataFrame, *plain: str, digits: int = 6, **rounded: str) -> DataFrame:
    """Select plain columns as they are, and the rest (doubles) rounded."""
    rest = [c for c in df.columns if c not in plain]
    return df.select(*plain, *[r6(c, digits).alias(c) for c in rest])


def noise31(key: str, seed) -> str:
    """The noise of a key, in SQL."""
    fold = lambda x: f"((({x} * {x}) % 2147483647 * 69621 + 12345) % 2147483647)"
    low = fold(f"((cast({key} as bigint) % 1073741824 * 48271 + 11) % 2147483647)")
    return fold(f"(({low} + cast({key} as bigint) // 1073741824 % 2147483647 * 16807 + cast({seed} as bigint) % 2147483647 * 40692) % 2147483647)")


def noise_u(key: str, seed) -> str:
    return f"(({noise31(key, seed)} + {noise31(key, f'({seed} + 1000003)')} / 2147483647e0) / 2147483647e0)"


def R(expr: str, digits: int = 6) -> str:
    return f"(round(cast({expr} as double), {digits}) + 0e0)"


def num(x: float) -> str:
    text = repr(float(x))
    return text if "e" in text else text + "e0"


# --- SQL text -------------------------------------------------------------------------------------------------


#: The published parameters of EPSG:5070: GRS 80, standard parallels 29.5 and 45.5, origin -96, 23 (fixed values).
GRS80_A, FLATTENING, PARALLEL_1, PARALLEL_2, ORIGIN_LAT, ALBERS_LON0 = 6378137.0, 1 / 298.257222101, 29.5, 45.5, 23.0, -96.0


def albers_constants() -> dict[str, float]:
    """Eccentricity, cone constant, C and the origin's radius, by the textbook's formulas (Snyder, 14-3 to 14-6)."""
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)

    def m(lat: float) -> float:
        return math.cos(math.radians(lat)) / math.sqrt(1 - e2 * math.sin(math.radians(lat)) ** 2)

    def q(lat: float) -> float:
        s = math.sin(math.radians(lat))
        return (1 - e2) * (s / (1 - e2 * s * s) + math.atanh(e * s) / e)

    n = (m(PARALLEL_1) ** 2 - m(PARALLEL_2) ** 2) / (q(PARALLEL_2) - q(PARALLEL_1))
    c = m(PARALLEL_1) ** 2 + n * q(PARALLEL_1)
    return {"e": e, "n": n, "c": c, "rho0": GRS80_A * math.sqrt(c - n * q(ORIGIN_LAT)) / n}


def albers_sql(lon: str, lat: str) -> tuple[str, str]:
    k = albers_constants()
    e, n = num(k["e"]), num(k["n"])
    s = f"sin(radians({lat}))"
    q = f"(({s} / (1e0 - {s} * {s} * {num(k['e'] ** 2)}) - ln((1e0 - {s} * {e}) / (1e0 + {s} * {e})) / {num(2 * k['e'])}) * {num(1 - k['e'] ** 2)})"
    rho = f"(sqrt({num(k['c'])} - {q} * {n}) * {num(GRS80_A / k['n'])})"
    theta = f"(radians({lon} - ({num(ALBERS_LON0)})) * {n})"
    return f"({rho} * sin({theta}))", f"({num(k['rho0'])} - {rho} * cos({theta}))"


def projected_points_sql(source: str, columns: str) -> str:
    x, y = albers_sql("lon", "lat")
    return f"SELECT {columns}, {x} AS x, {y} AS y FROM {source}"


def projected_edges_sql(source: str, columns: str) -> str:
    ax, ay = albers_sql("x1", "y1")
    bx, by = albers_sql("x2", "y2")
    return f"SELECT {columns}, {ax} AS x1, {ay} AS y1, {bx} AS x2, {by} AS y2 FROM {source}"


def inside_sql(points: str, edges: str, columns: str, group: str, x: str = "lon", y: str = "lat") -> str:
    """Brute force: every point against every edge, odd crossings are inside."""
    cross = f"(e.y1 > p.{y}) <> (e.y2 > p.{y}) AND p.{x} < e.x1 + (p.{y} - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)"
    return f"SELECT {columns} FROM {points} AS p JOIN {edges} AS e ON {cross} GROUP BY {group} HAVING count(*) % 2 = 1"


def distance_sql(px: str, py: str, s: str = "s") -> str:
    dx, dy = f"({s}.x2 - {s}.x1)", f"({s}.y2 - {s}.y1)"
    t = f"((({px} - {s}.x1) * {dx} + ({py} - {s}.y1) * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0))"
    fx_ = f"(CASE WHEN coalesce({t}, 0) <= 0 THEN {s}.x1 WHEN {t} >= 1 THEN {s}.x2 ELSE {s}.x1 + {t} * {dx} END)"
    fy_ = f"(CASE WHEN coalesce({t}, 0) <= 0 THEN {s}.y1 WHEN {t} >= 1 THEN {s}.y2 ELSE {s}.y1 + {t} * {dy} END)"
    return f"sqrt(({px} - {fx_}) * ({px} - {fx_}) + ({py} - {fy_}) * ({py} - {fy_}))"


def erfc_sql(z: str) -> str:
    """Independent check of a tail: Simpson's rule on 2/sqrt(pi) * exp(-t^2) over [z, z + 8]."""
    n = 4000
    return (
        f"(SELECT sum((CASE WHEN k = 0 OR k = {n} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * "
        f"exp(-pow({z} + k * 8e0 / {n}, 2))) * (8e0 / {n} / 3e0) * 2e0 / sqrt(pi()) "
        f"FROM (SELECT unnest(range(0, {n + 1})) AS k) AS simpson)"
    )


HIT = ("hit", inside_sql("facilities", "basin_edges", "p.sector, p.site_id, e.basin_id", "p.sector, p.site_id, e.basin_id"))
PRESENCE_COUNTS = ", ".join(
    f"cast(coalesce(sum(CASE WHEN h.sector = '{s}' THEN 1 ELSE 0 END), 0) as bigint) AS n_{s}" for s in SECTORS
)
PRESENCE_FLAGS = ", ".join(f"CASE WHEN n_{s} > 0 THEN 1 ELSE 0 END AS {s}_present" for s in SECTORS)
PRESENCE = (
    "presence",
    f"SELECT *, {PRESENCE_FLAGS} FROM (SELECT b.basin_id, b.area_km2, {PRESENCE_COUNTS} FROM basins AS b "
    "LEFT JOIN hit AS h ON h.basin_id = b.basin_id GROUP BY b.basin_id, b.area_km2) AS c",
)
PRESENCE_INPUT = ("facilities", "basin_edges", "basins")
MASTER = (
    "master",
    "SELECT p.*, m.* EXCLUDE (basin_id), CASE WHEN n_AI + n_Power + n_TRI > 0 THEN 1 ELSE 0 END AS any_infra "
    "FROM presence AS p JOIN basin_metrics_fx AS m ON m.basin_id = p.basin_id "
    "WHERE RBI IS NOT NULL AND season_conc IS NOT NULL AND CVQ IS NOT NULL",
)
MASTER_INPUT = (*PRESENCE_INPUT, "basin_metrics_fx")

STRESS_JOIN = (
    "bas",
    "SELECT b.basin_id, b.pfaf_id, cast(floor(b.pfaf_id / 100e0) as bigint) AS pfaf6, s.bws_raw AS stress_value FROM basins AS b LEFT JOIN "
    "(SELECT pfaf_id, min(bws_raw) AS bws_raw FROM stress WHERE pfaf_id IS NOT NULL AND pfaf_id <> -9999 GROUP BY pfaf_id) AS s "
    "ON s.pfaf_id = cast(floor(b.pfaf_id / 100e0) as bigint)",
)
CUTS = (
    "cuts",
    "SELECT quantile_cont(stress_value, 1e0 / 3e0) AS t1, quantile_cont(stress_value, 2e0 / 3e0) AS t2, quantile_cont(stress_value, 0.25) AS q1, "
    "quantile_cont(stress_value, 0.5) AS q2, quantile_cont(stress_value, 0.75) AS q3 FROM bas",
)
BINNED = (
    "binned",
    "SELECT bas.*, CASE WHEN stress_value IS NULL THEN NULL WHEN stress_value <= t1 THEN 'low' WHEN stress_value <= t2 THEN 'medium' ELSE 'high' END AS stress_tertile, "
    "CASE WHEN stress_value IS NULL THEN NULL WHEN stress_value <= q1 THEN 'Q1' WHEN stress_value <= q2 THEN 'Q2' WHEN stress_value <= q3 THEN 'Q3' ELSE 'Q4' END AS stress_quartile "
    "FROM bas CROSS JOIN cuts",
)
FAC = ("fac", "SELECT h.*, b.pfaf_id, b.stress_value, b.stress_tertile, b.stress_quartile FROM hit AS h JOIN binned AS b ON b.basin_id = h.basin_id WHERE b.stress_value IS NOT NULL")
STRESS_INPUT = ("basins", "stress")
FAC_INPUT = ("facilities", "basin_edges", *STRESS_INPUT)
FAC_CTES = (HIT, STRESS_JOIN, CUTS, BINNED, FAC)


def sql(inputs, body: str, *extra: tuple[str, str]) -> str:
    return fixtures.with_views(inputs, body, *extra)


# --- Spark inputs ---------------------------------------------------------------------------------------------


def located(spark, d) -> DataFrame:
    return points_in_polygons(fx(spark, d, "facilities"), fx(spark, d, "basin_edges"), "inner")


def presence(spark, d) -> DataFrame:
    return tb.presence_table(fx(spark, d, "basins").select("basin_id", "area_km2"), located(spark, d))


def master(spark, d, how: str = "inner") -> DataFrame:
    return tb.master_table(presence(spark, d), fx(spark, d, "basin_metrics_fx"), how)


def binned(spark, d) -> DataFrame:
    return stress_plan.binned_basins(fx(spark, d, "basins"), fx(spark, d, "stress"))


def facilities_with_stress(spark, d) -> DataFrame:
    return stress_plan.facilities_with_stress(fx(spark, d, "facilities"), fx(spark, d, "basin_edges"), binned(spark, d))
