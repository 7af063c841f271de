"""Projections, point-in-polygon, nearest water, radius search and random points."""

from __future__ import annotations

from pyspark.sql import functions as F

from catchmark.catalog import Query
from catchmark.catalog.common import (
    BINNED, CUTS, FAC, FAC_CTES, FAC_INPUT, HIT, SECTORS, STRESS_INPUT, STRESS_JOIN, R,
    albers_sql, binned, distance_sql, facilities_with_stress, fx, inside_sql, located, noise31, noise_u, num, projected_edges_sql,
    projected_points_sql, r6, sql,
)
from catchmark.functions.geometry import project_edges, project_points, utm_epsg
from catchmark.operators import polygons as pg
from catchmark.operators import sampling as sm
from catchmark.operators.nearest import nearest_features
from catchmark.operators import tables as tb
from catchmark.operators.tables import nearest_summary
from catchmark.plans import distance as dist_plan
from catchmark.plans import stress as stress_plan
from catchmark.sources.readers import major_rivers

QUERIES: dict[str, Query] = {}


def pip_left(spark, d):
    got = pg.points_in_polygons(fx(spark, d, "facilities"), fx(spark, d, "basin_edges"), "left")
    return got.select("sector", "site_id", "basin_id")


QUERIES["pip_left"] = Query(
    pip_left,
    sql(
        ["facilities", "basin_edges"],
        "SELECT f.sector, f.site_id, h.basin_id FROM facilities AS f LEFT JOIN hit AS h ON h.sector = f.sector AND h.site_id = f.site_id",
        HIT,
    ),
)
QUERIES["pip_inner"] = Query(
    lambda spark, d: located(spark, d).select("sector", "site_id", "basin_id"),
    sql(["facilities", "basin_edges"], "SELECT sector, site_id, basin_id FROM hit", HIT),
)


def domain_filter(spark, d):
    inside = pg.domain_filter(fx(spark, d, "facilities"), fx(spark, d, "basin_edges"), distinct_points=True)
    return inside.select("sector", "site_id", r6("lon").alias("lon"), r6("lat").alias("lat"))


QUERIES["domain_filter"] = Query(
    domain_filter,
    sql(
        ["facilities", "basin_edges"],
        f"SELECT sector, site_id, {R('lon')} AS lon, {R('lat')} AS lat FROM facilities WHERE (sector, site_id) IN (SELECT (sector, site_id) FROM hit)",
        HIT,
    ),
)
REACH_HIT = ("rhit", inside_sql("reaches", "basin_edges", "p.feature_id, p.ord, e.basin_id", "p.feature_id, p.ord, e.basin_id"))
REACH_MAP = ("rmap", "SELECT feature_id, min(basin_id) AS basin_id, min(ord) AS ord FROM rhit GROUP BY feature_id")
QUERIES["reach_map"] = Query(
    lambda spark, d: pg.reach_map(fx(spark, d, "reaches"), fx(spark, d, "basin_edges")).withColumn("ord", F.col("ord").cast("bigint")),
    sql(["reaches", "basin_edges"], "SELECT feature_id, basin_id, cast(ord as bigint) AS ord FROM rmap", REACH_HIT, REACH_MAP),
)
_X, _Y = albers_sql("lon", "lat")
QUERIES["albers_xy"] = Query(
    lambda spark, d: project_points(fx(spark, d, "facilities")).select("sector", "site_id", r6("x", 3).alias("x"), r6("y", 3).alias("y")),
    sql(["facilities"], f"SELECT sector, site_id, {R(_X, 3)} AS x, {R(_Y, 3)} AS y FROM facilities"),
)
QUERIES["utm_zone"] = Query(
    lambda spark, d: fx(spark, d, "facilities").select("sector", "site_id", utm_epsg(F.col("lon")).cast("bigint").alias("epsg")),
    sql(["facilities"], "SELECT sector, site_id, cast(32600 + floor((lon + 180e0) / 6e0) + 1 as bigint) AS epsg FROM facilities"),
)

# --- nearest --------------------------------------------------------------------------------------------------
SITES = ("sites", projected_points_sql("keyed_facilities", "k, sector, site_id"))
MAJOR = ("major", projected_edges_sql("water_segments WHERE kind <> 'River' OR ord >= 5", "kind, feature_id"))
WATER_INPUT = ("keyed_facilities", "water_segments")
_D = distance_sql("p.x", "p.y")


def nearest_river_km(spark, d):
    found = dist_plan.nearest_river_km(fx(spark, d, "keyed_facilities"), fx(spark, d, "water_segments"), "k")
    return found.select("k", r6("dist_km").alias("dist_km"))


QUERIES["nearest_river_km"] = Query(
    nearest_river_km,
    sql(
        WATER_INPUT,
        f"SELECT p.k, {R('min(' + _D + ') / 1e3')} AS dist_km FROM sites AS p CROSS JOIN major AS s WHERE s.kind = 'River' GROUP BY p.k",
        SITES, MAJOR,
    ),
)


def nearest_ties(spark, d):
    rivers = major_rivers(fx(spark, d, "water_segments"))
    found = nearest_features(project_points(fx(spark, d, "keyed_facilities")), project_edges(rivers), "k")
    return found.select("k", "feature_id", r6(F.col("dist") / 1000.0).alias("dist_km"))


RIVER_PAIRS = ("pairs", f"SELECT p.k, s.feature_id, {_D} AS dist FROM sites AS p CROSS JOIN major AS s WHERE s.kind = 'River'")
RIVER_NEAREST = ("near", "SELECT * FROM (SELECT *, rank() OVER (PARTITION BY k ORDER BY dist) AS rk FROM pairs) AS r WHERE rk = 1")
QUERIES["nearest_ties"] = Query(
    nearest_ties,
    sql(WATER_INPUT, f"SELECT DISTINCT k, feature_id, {R('dist / 1e3')} AS dist_km FROM near", SITES, MAJOR, RIVER_PAIRS, RIVER_NEAREST),
)


def nearest_water(spark, d):
    found = dist_plan.nearest_water(fx(spark, d, "keyed_facilities"), fx(spark, d, "water_segments"), "k")
    return found.select("k", *[r6(c).alias(c) for c in ("dist_river_km", "dist_lake_km", "dist_coast_km", "dist_any_km")], "nearest")


QUERIES["nearest_water"] = Query(
    nearest_water,
    sql(
        WATER_INPUT,
        f"SELECT k, {R('r')} AS dist_river_km, {R('l')} AS dist_lake_km, {R('c')} AS dist_coast_km, {R('least(r, l, c)')} AS dist_any_km, "
        "CASE WHEN r <= l AND r <= c THEN 'River' WHEN l <= c THEN 'Lake' ELSE 'Coast' END AS nearest FROM ("
        f"SELECT p.k, min({_D}) FILTER (WHERE s.kind = 'River') / 1e3 AS r, min({_D}) FILTER (WHERE s.kind = 'Lake') / 1e3 AS l, "
        f"min({_D}) FILTER (WHERE s.kind = 'Coast') / 1e3 AS c FROM sites AS p CROSS JOIN major AS s GROUP BY p.k) AS t",
        SITES, MAJOR,
    ),
)


def nearest_water_utm(spark, d):
    found = dist_plan.nearest_water_utm(fx(spark, d, "keyed_facilities"), fx(spark, d, "water_segments"), "k", min_order=3)
    return found.select("k", *[r6(c, 3).alias(c) for c in ("dist_river_km", "dist_lake_km", "dist_coast_km", "dist_any_km")], "nearest")


QUERIES["nearest_water_utm"] = Query(nearest_water_utm)


def distance_summary(spark, d):
    sites = fx(spark, d, "keyed_facilities")
    rivers = major_rivers(fx(spark, d, "water_segments"))
    found = nearest_features(project_points(sites), project_edges(rivers), "k").withColumn("dist_km", F.col("dist") / 1000.0)
    table = nearest_summary(found, sites.agg(F.count(F.lit(1)).alias("n_sites")), "dist_km", 10.0)
    return table.select("n_sites", *[r6(c).alias(c) for c in ("mean_dist", "median_dist", "share_within")])


QUERIES["distance_summary"] = Query(
    distance_summary,
    sql(
        WATER_INPUT,
        f"SELECT (SELECT count(*) FROM sites) AS n_sites, {R('avg(km)')} AS mean_dist, {R('median(km)')} AS median_dist, "
        f"{R('avg(CASE WHEN km <= 10 THEN 1e0 ELSE 0e0 END)')} AS share_within FROM (SELECT DISTINCT k, feature_id, dist / 1e3 AS km FROM near) AS t",
        SITES, MAJOR, RIVER_PAIRS, RIVER_NEAREST,
    ),
)
EDGES_M = ("edges_m", projected_edges_sql("basin_edges", "basin_id, ring"))


def circle_basins(spark, d):
    sites = project_points(fx(spark, d, "keyed_facilities"))
    return pg.polygons_near(sites, project_edges(fx(spark, d, "basin_edges")), 25_000.0, "k")


QUERIES["circle_basins"] = Query(
    circle_basins,
    sql(
        ["keyed_facilities", "basin_edges"],
        f"SELECT DISTINCT p.k, s.basin_id FROM sites AS p CROSS JOIN edges_m AS s WHERE {_D} <= 25e3 UNION SELECT k, basin_id FROM sin",
        SITES, EDGES_M, ("sin", inside_sql("sites", "edges_m", "p.k, e.basin_id", "p.k, e.basin_id", "x", "y")),
    ),
)


def site_basin(spark, d):
    bins = binned(spark, d).dropna(subset=["stress_value"])
    inside = located(spark, d).join(bins.select("basin_id"), "basin_id").select("sector", "site_id", "basin_id")
    found = pg.basins_of_site(inside, inside, bins.select("basin_id", "pfaf6", "stress_tertile"), ["sector", "site_id"], "pfaf6")
    return found.select("pfaf6", "sector", "site_id", "basin_id", "stress_tertile")


QUERIES["site_basin"] = Query(
    site_basin,
    sql(
        FAC_INPUT,
        "SELECT h.sector, h.site_id, a.pfaf6, b.basin_id, b.stress_tertile FROM hit AS h JOIN binned AS a ON a.basin_id = h.basin_id "
        "JOIN binned AS b ON b.pfaf6 = a.pfaf6 WHERE a.stress_value IS NOT NULL AND b.stress_value IS NOT NULL",
        *FAC_CTES[:4],
    ),
)
QUERIES["extent"] = Query(
    lambda spark, d: pg.extent(fx(spark, d, "basin_edges")).select(*[r6(c).alias(c) for c in ("minx", "miny", "maxx", "maxy")]),
    sql(
        ["basin_edges"],
        f"SELECT {R('min(least(x1, x2))')} AS minx, {R('min(least(y1, y2))')} AS miny, {R('max(greatest(x1, x2))')} AS maxx, {R('max(greatest(y1, y2))')} AS maxy FROM basin_edges",
    ),
)
QUERIES["boundary_lines"] = Query(
    lambda spark, d: pg.boundary_lines(fx(spark, d, "basin_edges"), "Basin", "basin_id").select(
        "kind", "feature_id", *[r6(c).alias(c) for c in ("x1", "y1", "x2", "y2")]
    ),
    sql(["basin_edges"], "SELECT 'Basin' AS kind, basin_id AS feature_id, " + ", ".join(f"{R(c)} AS {c}" for c in ("x1", "y1", "x2", "y2")) + " FROM basin_edges"),
)

# --- random points --------------------------------------------------------------------------------------------


def area_ctes(edges: str, tag: str = "") -> tuple[tuple[str, str], ...]:
    """``areas{tag}``: trapezoids between the heights of each polygon's vertices, with running area in whole units."""
    at = lambda y: f"CASE WHEN {y} = sy THEN sx WHEN {y} = ey THEN ex ELSE sx + ({y} - sy) * (ex - sx) / (ey - sy) END"
    return (
        (
            f"up{tag}",
            "SELECT basin_id AS id, CASE WHEN y1 < y2 THEN x1 ELSE x2 END AS sx, least(y1, y2) AS sy, CASE WHEN y1 < y2 THEN x2 ELSE x1 END AS ex, greatest(y1, y2) AS ey "
            f"FROM {edges} WHERE y1 <> y2",
        ),
        (f"ys{tag}", f"SELECT id, y AS y1, lead(y) OVER (PARTITION BY id ORDER BY y) AS y2 FROM (SELECT id, sy AS y FROM up{tag} UNION SELECT id, ey FROM up{tag}) AS s"),
        (f"cut{tag}", f"SELECT u.id, y1, y2, {at('y1')} AS l1, {at('y2')} AS l2 FROM up{tag} AS u JOIN ys{tag} AS h ON h.id = u.id AND sy <= y1 AND y2 <= ey"),
        (
            f"side{tag}",
            f"SELECT *, row_number() OVER w AS place, lead(l1) OVER w AS r1, lead(l2) OVER w AS r2 FROM cut{tag} WINDOW w AS (PARTITION BY id, y1 ORDER BY l1 + l2, l1, l2)",
        ),
        (f"trap{tag}", f"SELECT *, (r1 - l1 + r2 - l2) / 2e0 * (y2 - y1) AS area FROM side{tag} WHERE place % 2 = 1 AND r1 IS NOT NULL"),
        (f"unit{tag}", f"SELECT *, cast(round(area / (SELECT sum(area) FROM trap{tag}) * {num(sm.AREA_UNITS)}) AS bigint) AS units FROM trap{tag}"),
        (
            f"areas{tag}",
            "SELECT *, cast(sum(units) OVER (ORDER BY id, y1, place) AS bigint) - units AS before, cast(sum(units) OVER () AS bigint) AS whole "
            f"FROM unit{tag} WHERE units > 0",
        ),
    )


def place_sql(draws: str, seed: str, columns: str, tag: str = "") -> str:
    """A point for each row of ``draws`` (draw and the columns), by running area, height and place."""
    u, v, w = (noise_u("d.draw", f"({seed} + {k})") for k in sm.STREAMS)
    rise = "u * (w1 + w2) / greatest(w1 + sqrt(greatest(w1 * w1 + u * (w2 * w2 - w1 * w1), 0e0)), 1e-300)"
    aimed = f"SELECT d.*, least(cast(floor({u} * cast(whole AS double)) AS bigint), whole - 1) AS target, {v} AS u, {w} AS v FROM {draws} AS d CROSS JOIN (SELECT max(whole) AS whole FROM areas{tag}) AS s"
    met = f"SELECT a.*, t.*, t.r1 - t.l1 AS w1, t.r2 - t.l2 AS w2 FROM ({aimed}) AS a JOIN areas{tag} AS t ON a.target >= t.before AND a.target < t.before + t.units"
    risen = f"SELECT *, least({rise}, 1e0) AS t FROM ({met}) AS m"
    sides = f"SELECT *, l1 + (l2 - l1) * t AS l, r1 + (r2 - r1) * t AS r FROM ({risen}) AS m"
    return f"SELECT {columns}, l + (r - l) * v AS x, y1 + (y2 - y1) * t AS y, id AS basin_id FROM ({sides}) AS m"


def _draw_ctes(edges: str, n_draws: str, seed: int, tag: str = "") -> tuple[tuple[str, str], ...]:
    """``dhit``: so many draws from the polygons of ``edges``."""
    return (
        *area_ctes(edges, tag),
        (f"draws{tag}", f"SELECT unnest(range(0, cast({n_draws} as bigint))) AS draw"),
        (f"dhit{tag}", place_sql(f"draws{tag}", str(seed), "draw", tag)),
    )


_N = "(SELECT count(*) FROM facilities)"


def random_in_basins(spark, d):
    n = fx(spark, d, "facilities").count()
    got = sm.random_points_in_polygons(spark, fx(spark, d, "basin_edges"), n, 7)
    return got.select("draw", r6("x").alias("x"), r6("y").alias("y"), "basin_id")


QUERIES["random_in_basins"] = Query(
    random_in_basins,
    sql(
        ["facilities", "basin_edges"],
        f"SELECT draw, {R('x')} AS x, {R('y')} AS y, basin_id FROM dhit",
        *_draw_ctes("basin_edges", _N, 7),
    ),
)


def random_in_disk(spark, d):
    sites = project_points(fx(spark, d, "keyed_facilities"))
    points = sm.disk_points(sites, "k", 2, 10_000.0, 7)
    got = pg.points_in_polygons(points, project_edges(fx(spark, d, "basin_edges")), "left", "px", "py")
    return got.dropna(subset=["basin_id"]).select("k", "copy", r6("px", 3).alias("px"), r6("py", 3).alias("py"), "basin_id")


_KEY = "(k * 2 + t)"
DISK = (
    "disk",
    f"SELECT k, t AS copy, x + 1e4 * sqrt({noise_u(_KEY, 8)}) * cos({noise_u(_KEY, 7)} * 2e0 * pi()) AS px, y + 1e4 * sqrt({noise_u(_KEY, 8)}) * sin({noise_u(_KEY, 7)} * 2e0 * pi()) AS py "
    "FROM sites CROSS JOIN (VALUES (0), (1)) AS tries(t)",
)
QUERIES["random_in_disk"] = Query(
    random_in_disk,
    sql(
        ["keyed_facilities", "basin_edges"],
        f"SELECT k, cast(copy as bigint) AS copy, {R('px', 3)} AS px, {R('py', 3)} AS py, basin_id FROM kin",
        SITES, EDGES_M, DISK, ("kin", inside_sql("disk", "edges_m", "p.k, p.copy, p.px, p.py, e.basin_id", "p.k, p.copy, p.px, p.py, e.basin_id", "px", "py")),
    ),
)


def matched_basins(spark, d):
    edges, got = fx(spark, d, "basin_edges"), located(spark, d)
    each = [sm.matched_polygons(edges, got.filter(F.col("sector") == s)).withColumn("sector", F.lit(s)) for s in SECTORS]
    return tb.union_parts(*each).groupBy("sector", "basin_id").agg(F.count(F.lit(1)).alias("n_edges"))


QUERIES["matched_basins"] = Query(
    matched_basins,
    sql(
        ["facilities", "basin_edges"],
        "SELECT h.sector, e.basin_id, count(*) AS n_edges FROM basin_edges AS e JOIN (SELECT DISTINCT sector, basin_id FROM hit) AS h ON h.basin_id = e.basin_id GROUP BY h.sector, e.basin_id",
        HIT,
    ),
)


def reference(spark, d):
    n = fx(spark, d, "facilities").count()
    return stress_plan.reference_points(spark, fx(spark, d, "basin_edges"), binned(spark, d), n)


def reference_stress(spark, d):
    return reference(spark, d).select("draw", "basin_id", r6("stress_value").alias("stress_value"), "stress_tertile", "stress_quartile")


REF_CTES = (
    EDGES_M,
    *_draw_ctes("edges_m", _N, 10_007),
    ("ref", "SELECT t.draw, t.basin_id, b.stress_value, b.stress_tertile, b.stress_quartile FROM dhit AS t JOIN binned AS b ON b.basin_id = t.basin_id WHERE b.stress_value IS NOT NULL"),
)
REF_INPUT = ("facilities", "basin_edges", *STRESS_INPUT)
QUERIES["reference_stress"] = Query(
    reference_stress,
    sql(
        REF_INPUT, f"SELECT draw, basin_id, {R('stress_value')} AS stress_value, stress_tertile, stress_quartile FROM ref",
        STRESS_JOIN, CUTS, BINNED, *REF_CTES,
    ),
)


def matched_reference(spark, d):
    got = stress_plan.matched_reference(spark, facilities_with_stress(spark, d), fx(spark, d, "basin_edges"), binned(spark, d), "BASIN_MATCHED")
    return got.select("sector", "draw", "basin_id", "stress_tertile", "stress_quartile")


def matched_ctes() -> tuple[list[tuple[str, str]], str]:
    """The common tables and the rows of the matched reference."""
    ctes, selects = [*FAC_CTES], []
    for s in SECTORS:
        seed = stress_plan.SECTOR_SEED[s]
        n = f"(SELECT count(*) FROM fac WHERE sector = '{s}')"
        pool = f"greatest({n} + 1000, 5 * {n})"
        ctes.append((f"held_{s}", f"SELECT * FROM basin_edges WHERE basin_id IN (SELECT basin_id FROM fac WHERE sector = '{s}')"))
        ctes.extend(_draw_ctes(f"held_{s}", pool, 7 + seed + 20_000, f"_{s}"))
        ctes.append(
            (
                f"pick_{s}",
                f"SELECT p.draw, b.*, row_number() OVER (ORDER BY {noise31('p.draw', seed)}, p.draw) AS pos FROM dhit_{s} AS p "
                "JOIN binned AS b ON b.basin_id = p.basin_id WHERE b.stress_value IS NOT NULL",
            )
        )
        selects.append(f"SELECT '{s}' AS sector, draw, basin_id, stress_tertile, stress_quartile FROM pick_{s} WHERE pos <= {n}")
    return ctes, " UNION ALL ".join(selects)


_MATCHED, _MATCHED_ROWS = matched_ctes()
QUERIES["matched_reference"] = Query(matched_reference, sql(FAC_INPUT, _MATCHED_ROWS, *_MATCHED))


def first_by_bytes(spark, d):
    """The first tenth of all sites in the order of their coordinates' bytes."""
    sites = fx(spark, d, "facilities")
    return sm.first_by_bytes(sites, sites.count() // 10, "lon", "lat").select("sector", "site_id", r6("lon").alias("lon"), r6("lat").alias("lat"))


def bytes_ctes(source: str, columns: tuple[str, ...]) -> tuple[tuple[str, str], ...]:
    """``hexed``: ``source`` with h_<column>, the bytes of doubles between 2^-100 and 2^100 in size, least significant first, as hex digits."""
    each = lambda form: ", ".join(form(c) for c in columns)
    fit = "CASE WHEN abs({0}) >= pow(2e0, f_{0} + 1) THEN f_{0} + 1 WHEN abs({0}) < pow(2e0, f_{0}) THEN f_{0} - 1 ELSE f_{0} END AS e_{0}"
    whole = (
        "cast(abs({0}) * pow(2e0, 52 - e_{0}) AS hugeint) - 4503599627370496 + (cast(e_{0} AS hugeint) + 1023) * 4503599627370496 "
        "+ CASE WHEN {0} < 0 THEN cast(9223372036854775808 AS hugeint) ELSE 0 END AS w_{0}"
    )
    pairs = lambda c: " || ".join(f"lpad(hex(cast(w_{c} // {256**k} % 256 AS integer)), 2, '0')" for k in range(8)) + f" AS h_{c}"
    return (
        ("logs", f"SELECT *, {each('floor(log2(abs({0}))) AS f_{0}'.format)} FROM {source}"),
        ("exps", f"SELECT *, {each(fit.format)} FROM logs"),
        ("bits", f"SELECT *, {each(whole.format)} FROM exps"),
        ("hexed", f"SELECT *, {each(pairs)} FROM bits"),
    )


QUERIES["first_by_bytes"] = Query(
    first_by_bytes,
    sql(
        ["facilities"],
        f"SELECT sector, site_id, {R('lon')} AS lon, {R('lat')} AS lat FROM (SELECT *, row_number() OVER (ORDER BY h_lon, h_lat) AS rn FROM hexed) AS t WHERE rn <= {_N} // 10",
        *bytes_ctes("facilities", ("lon", "lat")),
    ),
)
