"""Stand-in inputs derived from the driver tables, written once as SQL that Spark and DuckDB both accept.

Every view grows with the tables: basins with customer, rivers with orders, lakes and TRI sites with part,
coast, reaches and Power sites with supplier, flow with lineitem and events, regions with nation.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def h31(key: str, seed) -> str:
    x = f"((cast({key} as bigint) * 48271 + {seed}) % 2147483647)"
    return f"((({x} * {x}) % 2147483647 * 69621 + 12345) % 2147483647)"


def u(key: str, seed) -> str:
    """Portable uniform in [0, 1) of a non-negative id."""
    return f"({h31(key, seed)} / 2147483647e0)"


def floordiv(a: str, b) -> str:
    return f"cast(floor(({a}) / cast({b} as double)) as bigint)"


# lattice corner (i, j) of a grid w cells wide: jitter below a quarter cell keeps every quadrilateral simple
def _vx(i: str, j: str) -> str:
    return f"(-116e0 + 38e0 / w * ({i} + 8e-2 * (({i} * 37 + {j} * 61) % 7 - 3)))"


def _vy(i: str, j: str) -> str:
    return f"(29e0 + 15e0 / w * ({j} + 8e-2 * (({i} * 53 + {j} * 29) % 7 - 3)))"


def _points(table: str, key: str, sector: str, seed: int) -> str:
    return (
        f"SELECT '{sector}' AS sector, {key} AS site_id, -124e0 + 58e0 * {u(key, seed)} AS lon, "
        f"245e-1 + 25e0 * {u(key, seed + 1)} AS lat FROM {table}"
    )


def _distance_rows(grp: str, seed: int) -> str:
    cols = []
    for n, kind in enumerate(("river", "lake", "coast")):
        a, b = u("k", seed + 10 * n), u("k", seed + 10 * n + 5)
        cols.append(
            f"CASE WHEN site_id % 29 = {n} THEN NULL WHEN site_id % 31 = {n} THEN 0e0 "
            f"ELSE round({120 if grp == 'sector' else 130}e0 * {a} * {b}, 1) END AS dist_{kind}_km"
        )
    return f"SELECT sector, '{grp}' AS grp, site_id, {', '.join(cols)} FROM keyed_facilities"


def _edge(case_of: list[tuple[str, str]], n: int) -> str:
    """Corner n..n+3 of an edge list as a CASE over e."""
    whens = " ".join(f"WHEN {e} THEN {case_of[e][n]}" for e in range(len(case_of)))
    return f"CASE e {whens} END"


def _basin_edges() -> str:
    corner = [("x00", "y00"), ("x10", "y10"), ("x11", "y11"), ("x01", "y01")]
    # e 0..3: outer ring; e 4..7: a square hole in the middle of every 11th basin
    r = "1e-1"
    hole = [
        (f"(mx - {r} * 38e0 / w)", f"(my - {r} * 15e0 / w)"),
        (f"(mx + {r} * 38e0 / w)", f"(my - {r} * 15e0 / w)"),
        (f"(mx + {r} * 38e0 / w)", f"(my + {r} * 15e0 / w)"),
        (f"(mx - {r} * 38e0 / w)", f"(my + {r} * 15e0 / w)"),
    ]
    sides = [(*corner[k], *corner[(k + 1) % 4]) for k in range(4)] + [(*hole[k], *hole[(k + 1) % 4]) for k in range(4)]
    cols = ", ".join(f"{_edge(sides, n)} AS {name}" for n, name in enumerate(("x1", "y1", "x2", "y2")))
    return (
        f"SELECT basin_id, CASE WHEN e < 4 THEN 0 ELSE 1 END AS ring, {cols} FROM basin_corners "
        "CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS side(e) WHERE e < 4 OR basin_id % 11 = 10"
    )


def _region_edges() -> str:
    x = lambda i: f"(-125e0 + 12e0 * ({i}))"
    y = lambda j: f"(24e0 + 53e-1 * ({j}))"
    corner = [(x("i"), y("j")), (x("i + 1"), y("j")), (x("i + 1"), y("j + 1")), (x("i"), y("j + 1"))]
    sides = [(*corner[k], *corner[(k + 1) % 4]) for k in range(4)]
    cols = ", ".join(f"{_edge(sides, n)} AS {name}" for n, name in enumerate(("x1", "y1", "x2", "y2")))
    return f"SELECT huc2, 0 AS ring, {cols} FROM region_cells CROSS JOIN (VALUES (0), (1), (2), (3)) AS side(e)"


def _lakes() -> str:
    corner = [("cx - r", "cy - r"), ("cx + r", "cy - r"), ("cx + r", "cy + r"), ("cx - r", "cy + r")]
    sides = [(*corner[n], *corner[(n + 1) % 4]) for n in range(4)]
    cols = ", ".join(f"{_edge(sides, n)} AS {name}" for n, name in enumerate(("x1", "y1", "x2", "y2")))
    return (
        f"SELECT 'Lake' AS kind, k AS feature_id, cast(NULL as int) AS ord, {cols} "
        f"FROM (SELECT p_partkey AS k, -123e0 + 56e0 * {u('p_partkey', 611)} AS cx, 25e0 + 24e0 * {u('p_partkey', 612)} AS cy, "
        "2e-2 + 1e-2 * (p_partkey % 5) AS r FROM part) AS p CROSS JOIN (VALUES (0), (1), (2), (3)) AS side(e)"
    )


PATHWAY_NAMES = (
    "Surface-water leaning",
    "Mixed groundwater and nearby surface water",
    "Surface-water county, no nearby mapped source",
    "Groundwater leaning",
    "Mixed or uncertain",
)


def _pathways() -> str:
    kinds = (
        "SELECT 'AI' AS sector, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 "
        "WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS c FROM customer UNION ALL "
        "SELECT 'Power', cast(s_suppkey % 5 as int) FROM supplier UNION ALL SELECT 'TRI', p_size % 5 FROM part"
    )
    cols = ", ".join(f'sum(CASE WHEN c = {n} THEN 100e0 ELSE 0e0 END) / count(*) AS "{name}"' for n, name in enumerate(PATHWAY_NAMES))
    return f"SELECT sector, {cols} FROM ({kinds}) AS t GROUP BY sector"


def _metrics() -> str:
    cols = [("meanQ", 811, "50e0"), ("CVQ", 821, "3e0"), ("RBI", 831, "1e0"), ("season_conc", 841, "75e-2"), ("Q10", 851, "10e0"), ("Q90", 861, "120e0")]
    parts = []
    for n, (name, seed, scale) in enumerate(cols):
        parts.append(
            f"CASE WHEN basin_id % 97 = {n} THEN NULL ELSE "
            f"round({scale} * {u('basin_id', seed)} * (5e-1 + {u('basin_id', seed + 3)}), 3) END AS {name}"
        )
    return f"SELECT basin_id, {', '.join(parts)} FROM basins"


# name -> (views it reads, SQL); the order is a valid order of definition
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "facilities": (
        (),
        " UNION ALL ".join(
            [
                _points("customer", "c_custkey", "AI", 101),
                _points("supplier", "s_suppkey", "Power", 201),
                _points("part", "p_partkey", "TRI", 301),
            ]
        ),
    ),
    "facilities_raw": (
        ("facilities",),
        "SELECT sector, site_id, "
        "CASE site_id % 50 WHEN 1 THEN 'x' WHEN 2 THEN '' WHEN 3 THEN 'NaN' WHEN 4 THEN ' 12.5 ' WHEN 5 THEN '1e2' "
        "ELSE cast(round(lon, 4) as string) END AS lon_text, "
        "CASE site_id % 70 WHEN 9 THEN 'n/a' WHEN 10 THEN NULL ELSE cast(round(lat, 4) as string) END AS lat_text FROM facilities",
    ),
    "keyed_facilities": (
        ("facilities",),
        "SELECT *, site_id * 3 + CASE sector WHEN 'AI' THEN 0 WHEN 'Power' THEN 1 ELSE 2 END AS k FROM facilities",
    ),
    "basin_cells": (
        (),
        "SELECT c_custkey AS basin_id, c_custkey % w AS i, "
        + floordiv("c_custkey", "w")
        + " AS j, w FROM customer CROSS JOIN (SELECT cast(ceil(sqrt(count(*))) as bigint) AS w FROM customer) AS grid",
    ),
    "basins": (
        (),
        "SELECT c_custkey AS basin_id, 71000000 + 50 * c_custkey AS pfaf_id, cast(500 + 10 * (c_custkey % 37) as double) AS area_km2 FROM customer",
    ),
    "basin_corners": (
        ("basin_cells",),
        "SELECT *, (x00 + x10 + x11 + x01) / 4e0 AS mx, (y00 + y10 + y11 + y01) / 4e0 AS my FROM (SELECT basin_id, w, "
        f"{_vx('i', 'j')} AS x00, {_vy('i', 'j')} AS y00, {_vx('(i + 1)', 'j')} AS x10, {_vy('(i + 1)', 'j')} AS y10, "
        f"{_vx('(i + 1)', '(j + 1)')} AS x11, {_vy('(i + 1)', '(j + 1)')} AS y11, {_vx('i', '(j + 1)')} AS x01, {_vy('i', '(j + 1)')} AS y01 "
        "FROM basin_cells) AS q",
    ),
    "basin_edges": (("basin_corners",), _basin_edges()),
    "region_cells": (
        (),
        "SELECT lpad(cast(1 + n_nationkey as string), 2, '0') AS huc2, n_nationkey % 5 AS i, "
        + floordiv("n_nationkey", 5)
        + " AS j FROM nation",
    ),
    "region_edges": (("region_cells",), _region_edges()),
    "stress": (
        ("basins",),
        f"SELECT key6 AS pfaf_id, CASE WHEN key6 % 13 = 0 THEN NULL ELSE 5e0 * {u('key6', 401)} END AS bws_raw "
        f"FROM (SELECT {floordiv('pfaf_id', 100)} AS key6 FROM basins) AS k UNION ALL SELECT cast(-9999 as bigint), 99e-1",
    ),
    "rivers": (
        (),
        "SELECT 'River' AS kind, k AS feature_id, cast(1 + k % 9 as int) AS ord, x AS x1, y AS y1, "
        f"x + 6e-1 * ({u('k', 603)} - 5e-1) AS x2, y + 6e-1 * ({u('k', 604)} - 5e-1) AS y2 FROM (SELECT o_orderkey AS k, "
        f"-124e0 + 58e0 * {u('o_orderkey', 601)} AS x, 245e-1 + 25e0 * {u('o_orderkey', 602)} AS y FROM orders) AS q",
    ),
    "lakes": ((), _lakes()),
    "coast": (
        (),
        "SELECT 'Coast' AS kind, k AS feature_id, cast(NULL as int) AS ord, "
        f"-1255e-1 + {u('k', 621)} AS x1, 23e0 + 28e0 * k / n AS y1, -1255e-1 + {u('(k + 1)', 621)} AS x2, 23e0 + 28e0 * (k + 1) / n AS y2 "
        "FROM (SELECT s_suppkey AS k FROM supplier) AS s CROSS JOIN (SELECT count(*) AS n FROM supplier) AS c",
    ),
    "water_segments": (
        ("rivers", "lakes", "coast"),
        "SELECT * FROM rivers UNION ALL SELECT * FROM lakes UNION ALL SELECT * FROM coast",
    ),
    "reaches": (
        (),
        f"SELECT s_suppkey AS feature_id, -116e0 + 38e0 * {u('s_suppkey', 501)} AS lon, 29e0 + 15e0 * {u('s_suppkey', 502)} AS lat, "
        "CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE cast(1 + s_suppkey % 9 as int) END AS ord FROM supplier",
    ),
    "streamflow": ((), "SELECT l_suppkey AS feature_id, l_shipdate AS time, l_quantity AS q FROM lineitem"),
    "hourly": ((), "SELECT user_id AS feature_id, ts AS time, value AS q FROM events"),
    "distances": (
        ("keyed_facilities",),
        _distance_rows("sector", 701) + " UNION ALL " + _distance_rows("random", 751),
    ),
    "basin_metrics_fx": (("basins",), _metrics()),
    "pathways": ((), _pathways()),
}


def _closure(names) -> list[str]:
    needed, stack = set(), list(names)
    while stack:
        name = stack.pop()
        if name not in needed:
            needed.add(name)
            stack.extend(VIEWS[name][0])
    return [name for name in VIEWS if name in needed]


def with_views(names, body: str, *extra: tuple[str, str]) -> str:
    """SQL text: the fixture views as CTEs, then further CTEs, then the body."""
    ctes = [f"{n} AS ({VIEWS[n][1]})" for n in _closure(names)] + [f"{n} AS ({sql})" for n, sql in extra]
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the Parquet tables of one scale-factor directory."""
    sql = with_views([name], f"SELECT * FROM {name}")
    for table in TABLES:
        if re.search(rf"\b{table}\b", sql):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    # Spark names columns with back-ticks where standard SQL uses double quotes
    return spark.sql(sql.replace('"', "`"))
