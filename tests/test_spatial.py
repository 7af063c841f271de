"""Spatial operators against brute force on small, awkward fixtures."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from catchmark.functions.exact import exact_sign
from catchmark.operators import polygons as pg
from catchmark.operators import sampling as sm
from catchmark.operators.nearest import nearest_distance, nearest_features

EDGE = "basin_id long, ring int, x1 double, y1 double, x2 double, y2 double"
SEG = "feature_id long, kind string, x1 double, y1 double, x2 double, y2 double"


def ring(bid, pts, r=0):
    return [(bid, r, *map(float, pts[i]), *map(float, pts[(i + 1) % len(pts)])) for i in range(len(pts))]


def star(bid, cx, cy, radius, n, rng):
    """A ragged, non-convex polygon."""
    pts = []
    for k in range(n):
        a, r = 2 * math.pi * k / n, radius * rng.uniform(0.3, 1.0)
        pts.append((cx + r * math.cos(a), cy + r * math.sin(a)))
    return ring(bid, pts)


def inside(px, py, edges):
    hits = 0
    for _, _, x1, y1, x2, y2 in edges:
        if (y1 > py) != (y2 > py) and px < x1 + (py - y1) * (x2 - x1) / (y2 - y1):
            hits += 1
    return hits % 2 == 1


def test_within_excludes_boundary_and_keeps_unmatched(spark):
    edges = spark.createDataFrame(ring(7, [(0, 0), (1, 0), (1, 1), (0, 1)]), EDGE)
    pts = [(1, 0.5, 0.5), (2, 1.0, 0.5), (3, 2.0, 2.0), (4, 0.5, 0.0), (5, 0.0, 0.0), (6, 0.25, 1.0)]
    points = spark.createDataFrame(pts, "id long, lon double, lat double")
    got = {r["id"]: r["basin_id"] for r in pg.points_in_polygons(points, edges, "left").collect()}
    assert got == {1: 7, 2: None, 3: None, 4: None, 5: None, 6: None}


def test_holes_multiparts_and_overlaps(spark):
    edges = (
        ring(1, [(0, 0), (4, 0), (4, 4), (0, 4)])
        + ring(1, [(1, 1), (3, 1), (3, 3), (1, 3)], 1)  # hole
        + ring(2, [(3.5, 3.5), (6, 3.5), (6, 6), (3.5, 6)])  # overlaps 1
        + ring(2, [(10, 0), (11, 0), (11, 1), (10, 1)])  # second part
    )
    pts = [(1, 2.0, 2.0), (2, 0.5, 0.5), (3, 3.75, 3.75), (4, 10.5, 0.5)]
    points = spark.createDataFrame(pts, "id long, lon double, lat double")
    frame = spark.createDataFrame(edges, EDGE)
    got = sorted((r["id"], r["basin_id"]) for r in pg.points_in_polygons(points, frame, "inner").collect())
    assert got == [(2, 1), (3, 1), (3, 2), (4, 2)]
    assert pg.domain_filter(points, frame).count() == 4
    assert sorted(r["id"] for r in pg.domain_filter(points, frame, distinct_points=True).collect()) == [2, 3, 4]


@pytest.mark.parametrize("per_cell", [1, 8, 1000])
def test_pip_equals_brute_force(spark, per_cell, monkeypatch):
    monkeypatch.setattr(pg, "EDGES_PER_CELL", per_cell)
    rng = random.Random(3)
    polys = {b: star(b, rng.uniform(-5, 5), rng.uniform(-5, 5), rng.uniform(0.5, 3), 25, rng) for b in range(12)}
    polys[12] = star(12, 0, 0, 7, 400, rng)  # many edges, over all the others
    polys |= {20 + b: star(20 + b, rng.uniform(-5, 5), rng.uniform(-5, 5), 0.05, 6, rng) for b in range(40)}
    pts = [(i, rng.uniform(-8, 8), rng.uniform(-8, 8)) for i in range(400)]
    # a third of the points at one place
    pts += [(1000 + i, 0.1, 0.2) for i in range(200)]
    want = sorted((i, b) for i, x, y in pts for b, e in polys.items() if inside(x, y, e))
    points = spark.createDataFrame(pts, "id long, lon double, lat double").repartition(5)
    edges = spark.createDataFrame([e for p in polys.values() for e in p], EDGE)
    got = sorted((r["id"], r["basin_id"]) for r in pg.points_in_polygons(points, edges, "inner").collect())
    assert got == want


def exact_place(x, y, edges):
    """None on the boundary, else whether inside, with rational numbers."""
    x, y, odd = Fraction(x), Fraction(y), False
    for _, _, *e in edges:
        x1, y1, x2, y2 = map(Fraction, e)
        side = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
        if side == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return None
        if (y1 > y) != (y2 > y) and (side > 0) == (y2 > y1):
            odd = not odd
    return odd


def test_boundary_points_are_decided_exactly(spark):
    rng = random.Random(21)
    polys, pts = {}, []
    for b in range(8):
        corners = [(rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(3)]
        polys[b] = ring(b, corners)
        for _ in range(60):  # on a slanted edge as near as doubles come, and up to two steps beside it
            (x1, y1), (x2, y2) = rng.sample(corners, 2)
            t = rng.choice([0.5, 0.25, rng.random()])
            x, y = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
            for _ in range(rng.randrange(3)):
                x, y = math.nextafter(x, rng.choice([-9, 9])), math.nextafter(y, rng.choice([-9, 9]))
            pts.append((len(pts), x, y))
    polys[100] = ring(100, [(0.1, 0.1), (0.7, 0.7), (0.1, 0.7)])
    pts += [(len(pts) + k, k / 64, k / 64) for k in range(7, 45)] + [(9000 + k, 0.1 + k * 1e-17, 0.1) for k in range(3)]  # exactly on a diagonal
    pts += [(9100 + k, *c) for k, c in enumerate(p for b in range(8) for _, _, *p in [e[:4] for e in polys[b]])]  # corners
    edges = spark.createDataFrame([e for p in polys.values() for e in p], EDGE)
    got = {(r["id"], r["basin_id"]) for r in pg.points_in_polygons(spark.createDataFrame(pts, "id long, lon double, lat double"), edges, "inner").collect()}
    want = {(i, b) for i, x, y in pts for b, e in polys.items() if exact_place(x, y, e)}
    assert got == want
    assert sum(exact_place(x, y, polys[100]) is None for i, x, y in pts) > 30
    plain = {(i, b) for i, x, y in pts for b, e in polys.items() if inside(x, y, e)}
    assert plain != want  # doubles alone get some wrong


def test_exact_sign_of_sums(spark):
    rng = random.Random(4)
    cases = [[1e100, 1.0, -1e100], [1e100, -1e100], [], [0.0], [2.0**53, 1.0, -(2.0**53), -1.0], [1e16, 1.0, 1.0, -1e16, -2.0, 1e-300]]
    cases += [[rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randrange(-60, 60) for _ in range(rng.randrange(1, 9))] for _ in range(60)]
    cases += [c + [-sum(c)] for c in cases[6:40]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c array<double>")
    got = {r["i"]: r["s"] for r in df.select("i", exact_sign(F.col("c")).alias("s")).collect()}
    total = [sum(map(Fraction, c)) for c in cases]
    assert got == {i: (t > 0) - (t < 0) for i, t in enumerate(total)}


def test_points_are_moved_once(spark):
    squares = [e for k in range(6) for e in ring(k, [(0, 0), (2**k, 0), (2**k, 2**k), (0, 2**k)])]  # six sizes of cells
    index = pg.polygon_index(spark.createDataFrame(squares, EDGE))
    points = spark.range(50).selectExpr("id", "id * 0.6 + 0.3 as lon", "id * 0.6 + 0.3 as lat")
    assert index.select("level").distinct().count() >= 5
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = pg.locate(points, index, "inner")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == sum(0.6 * i + 0.3 < 2**k for i in range(50) for k in range(6))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 1 and plan.count("Exchange hashpartitioning") == 2


def test_polygons_per_cell_stay_level(spark):
    most = []
    for side in (6, 24):
        squares = [e for i in range(side) for j in range(side) for e in ring(i * side + j, [(60 * i / side, 60 * j / side), (60 * (i + 1) / side, 60 * j / side), (60 * (i + 1) / side, 60 * (j + 1) / side), (60 * i / side, 60 * (j + 1) / side)])]
        index = pg.polygon_index(spark.createDataFrame(squares, EDGE))
        most.append(index.agg(F.max(F.size("polys"))).first()[0])
    assert max(most) <= 9


def test_no_polygons_and_flat_ones(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5)], "id long, lon double, lat double")
    none = spark.createDataFrame([], EDGE)
    assert [r["basin_id"] for r in pg.points_in_polygons(points, none, "left").collect()] == [None]
    assert pg.points_in_polygons(points, none, "inner").count() == pg.domain_filter(points, none, distinct_points=True).count() == 0
    flat = spark.createDataFrame(ring(1, [(0, 0.5), (1, 0.5)]), EDGE)
    assert pg.points_in_polygons(points, flat, "inner").count() == 0


def test_a_site_without_basin_stops(spark):
    sites = spark.createDataFrame([(1,), (2,)], "id long")
    located, keys = spark.createDataFrame([(1, 7)], "id long, basin_id long"), spark.createDataFrame([(7, 70), (8, 70), (9, 90)], "basin_id long, pfaf6 long")
    got = pg.basins_of_site(sites.filter("id = 1"), located, keys, ["id"], "pfaf6").collect()
    assert sorted(r["basin_id"] for r in got) == [7, 8]
    with pytest.raises(Exception, match="no basin"):
        pg.basins_of_site(sites, located, keys, ["id"], "pfaf6").collect()


def seg_dist(px, py, x1, y1, x2, y2):
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((px - x1) * dx + (py - y1) * dy) / n)) if n else 0.0
    return math.hypot(px - x1 - t * dx, py - y1 - t * dy)


@pytest.mark.parametrize("depth", [1, 3, 6])
def test_nearest_equals_brute_force(spark, depth):
    rng = random.Random(5)
    segs = []
    for i in range(300):  # a dense cluster, sparse outliers, and one very long line
        cx, cy, s = (10, 10, 0.5) if i < 200 else (0, 0, 60)
        x, y = cx + rng.uniform(-s, s), cy + rng.uniform(-s, s)
        segs.append((i, "a" if i % 2 else "b", x, y, x + rng.uniform(-1, 1), y + rng.uniform(-1, 1)))
    segs.append((300, "a", -80.0, -70.0, 75.0, 80.0))
    segs += [(400 + i, *segs[7][1:]) for i in range(100)]  # copies of one segment
    pts = [(i, rng.uniform(-90, 90), rng.uniform(-90, 90)) for i in range(150)] + [(200 + i, 10.2, 9.9) for i in range(60)]
    points = spark.createDataFrame(pts, "pid long, x double, y double").repartition(3)
    segments = spark.createDataFrame(segs, SEG)
    bounds = (-128.0, -128.0, 256.0)
    got = {(r["pid"], r["kind"]): r["dist"] for r in nearest_distance(points, segments, "pid", (), ["kind"], depth, bounds).collect()}
    for pid, x, y in pts:
        for kind in "ab":
            want = min(seg_dist(x, y, *s[2:]) for s in segs if s[1] == kind)
            assert got.pop((pid, kind)) == pytest.approx(want, abs=1e-9)
    assert not got


def test_nearest_keeps_ties_and_copies(spark):
    segs = [(1, "a", 0.0, 0.0, 1.0, 1.0), (2, "a", 1.0, 1.0, 2.0, 0.0), (3, "a", 1.0, 1.0, 2.0, 0.0), (4, "a", 50.0, 50.0, 51.0, 51.0)]
    points = spark.createDataFrame([(1, 1.0, 3.0), (2, 50.0, 50.0)], "pid long, x double, y double")
    got = nearest_features(points, spark.createDataFrame(segs, SEG), "pid", depth=4, bounds=(-128.0, -128.0, 256.0)).collect()
    assert sorted((r["pid"], r["feature_id"], r["dist"]) for r in got) == [(1, 1, 2.0), (1, 2, 2.0), (1, 3, 2.0), (2, 4, 0.0)]


def test_long_lines_among_many_are_settled_by_the_grid(spark):
    """Boxes around long lines hold nearly all others; cells that their lines pass do not, and no point is left for the trees."""
    from catchmark.operators import nearest as nr

    rng = random.Random(9)
    segs = [(i, "a", x, y, x + rng.uniform(-9, 9), y + rng.uniform(-9, 9)) for i, (x, y) in enumerate((rng.uniform(0, 30), rng.uniform(0, 30)) for _ in range(800))]
    pts = [(i, rng.uniform(8, 22), rng.uniform(8, 22)) for i in range(60)]
    points, lines = spark.createDataFrame(pts, "pid long, x double, y double"), spark.createDataFrame(segs, SEG)
    settled, rest, _, _ = nr._close_by(*nr._inputs(points, lines, "pid", (), ()), "pid", (), ())
    got = {r["pid"]: r["dist"] for r in settled.collect()}
    assert rest.isEmpty() and len(got) == 60
    for pid, x, y in pts:
        assert got[pid] == pytest.approx(min(seg_dist(x, y, *s[2:]) for s in segs), abs=1e-9)


def zigzag(n):
    return [(i, "a", 100.0 * (i * 7919 % 101) / 101, float(i), 100.0 * ((i + 1) * 7919 % 101) / 101, float(i + 1)) for i in range(n)]


def test_far_points_meet_whole_leaves_as_arrays(spark, monkeypatch):
    """Points inland of a coast: distances and ties as by brute force, in several tasks, and no pair of a point and a segment is a row."""
    from catchmark.operators import nearest as nr

    for name, few in (("SEGMENTS_PER_LEAF", 8), ("SEGMENTS_PER_BLOCK", 60), ("POINTS_PER_BLOCK", 10)):
        monkeypatch.setattr(nr, name, few)
    rng = random.Random(3)
    segs = zigzag(400) + [(900, "a", 100.0, 450.0, 120.0, 450.0), (901, "a", 120.0, 450.0, 100.0, 450.0)]
    pts = [(i, rng.uniform(600, 3000), rng.uniform(-300, 900)) for i in range(120)] + [(500, 4000.0, 450.0)]
    points, lines = spark.createDataFrame(pts, "pid long, x double, y double"), spark.createDataFrame(segs, SEG)
    got = {}
    for r in nearest_features(points, lines, "pid").collect():
        got.setdefault(r["pid"], []).append((r["feature_id"], r["dist"]))
    for pid, x, y in pts:
        near = {s[0]: seg_dist(x, y, *s[2:]) for s in segs}
        assert {f for f, _ in got[pid]} == {f for f, d in near.items() if d <= min(near.values()) + 1e-9}
        assert got[pid][0][1] == pytest.approx(min(near.values()), abs=1e-9)
    assert {f for f, _ in got[500]} == {900, 901}
    rest = points.withColumns({"x": F.col("x"), "y": F.col("y")})
    plan = nr._candidates(rest, lines.select("x1", "y1", "x2", "y2"), "pid", (), (), None, None)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and not [line for line in plan.splitlines() if "Join" in line and "pid" in line and "x1" in line]


def test_tiles_are_searched_as_brute_force(spark, monkeypatch):
    """Many small tiles, crowded ones in several tasks, copies and ties, points on borders of tiles."""
    from catchmark.operators import nearest as nr

    for name, few in (("SEGMENTS_PER_TILE", 5), ("POINTS_PER_TASK", 7)):
        monkeypatch.setattr(nr, name, few)
    rng = random.Random(4)
    segs = [(i, "a", x, y, x + rng.randint(-2, 2), y + rng.randint(-2, 2)) for i, (x, y) in enumerate((rng.randint(0, 40), rng.randint(0, 40)) for _ in range(500))]
    segs = [(i, k, *map(float, e)) for i, k, *e in segs]
    pts = [(i, float(rng.randint(-3, 44)), float(rng.randint(-3, 44))) for i in range(150)] + [(300 + i, 20.0, 20.0) for i in range(30)]
    got = {}
    for r in nearest_features(spark.createDataFrame(pts, "pid long, x double, y double"), spark.createDataFrame(segs, SEG), "pid").collect():
        got.setdefault(r["pid"], set()).add(r["feature_id"])
        assert r["dist"] == pytest.approx(min(seg_dist(pts[r["pid"]][1], pts[r["pid"]][2], *s[2:]) for s in segs) if r["pid"] < 150 else r["dist"], abs=1e-9)
    for pid, x, y in pts:
        near = {s[0]: seg_dist(x, y, *s[2:]) for s in segs}
        assert got[pid] == {f for f, d in near.items() if d <= min(near.values()) + 1e-9}


def test_nearest_far_away_and_without_segments(spark):
    """Bounds come from the data, and a point keeps its row when no segment has its key or it has no place."""
    points = spark.createDataFrame([(1, 9e6, 0.0, "a"), (2, 0.5, 0.5, "a"), (3, 0.0, 0.0, "b"), (4, None, 0.0, "a"), (5, float("nan"), 0.0, "a")], "pid long, x double, y double, kind string")
    segments = spark.createDataFrame([(1, "a", 0.0, 0.0, 1.0, 1.0), (2, "a", -6.13e6, 6.3e6, -6.1e6, 6.3e6)], SEG)
    got = {r["pid"]: r["dist"] for r in nearest_distance(points, segments, "pid", ["kind"]).collect()}
    assert got[1] == pytest.approx(math.hypot(9e6 - 1, 1)) and got[2] == 0 and got[3] is got[4] is got[5] is None
    one = nearest_distance(points.filter("pid = 2"), segments.limit(0), "pid", ["kind"]).collect()
    assert [r["dist"] for r in one] == [None]


@pytest.mark.parametrize("margin", [0.0, 2.0, 400.0])
def test_water_in_a_zone_is_looked_for_among_near_lines_first(spark, margin, monkeypatch):
    """Sites whose nearest line lies beyond the margin, or that have none of a kind near, search all lines of the zone."""
    from catchmark.functions.geometry import utm_xy
    from catchmark.plans import distance as plan

    monkeypatch.setattr(plan, "MARGIN", margin)
    rng = random.Random(6)
    lines = [(k, i, 5, x, y, x + rng.uniform(-2, 2), y + rng.uniform(-2, 2)) for k, n, low, high in (("River", 40, -110, -70), ("Lake", 3, -80, -79), ("Coast", 5, -124, -123))
             for i, (x, y) in enumerate((rng.uniform(low, high), rng.uniform(26, 48)) for _ in range(n))]
    sites = [(i, rng.uniform(-112, -75), rng.uniform(25, 49)) for i in range(30)] + [(99, None, 40.0)]
    got = plan.nearest_water_utm(spark.createDataFrame(sites, "k long, lon double, lat double"), spark.createDataFrame(lines, "kind string, feature_id long, ord int, x1 double, y1 double, x2 double, y2 double"), "k")
    got = {r["k"]: (r["dist_river_km"], r["dist_lake_km"], r["dist_coast_km"]) for r in got.collect()}
    assert got.pop(99) == (None, None, None) and len(got) == 30
    xy = lambda x, y, z: tuple(c.alias(n) for c, n in zip(utm_xy(F.col(x), F.col(y), z), (f"e{x}", f"n{y}")))
    zone = F.floor((F.col("lon") + 180) / 6) + 1
    pairs = spark.createDataFrame(sites[:30], "k long, lon double, lat double").crossJoin(spark.createDataFrame(lines, "kind string, f long, o int, x1 double, y1 double, x2 double, y2 double"))
    want = {}
    for r in pairs.select("k", "kind", *xy("lon", "lat", zone), *xy("x1", "y1", zone), *xy("x2", "y2", zone)).collect():
        d = seg_dist(*r[2:]) / 1000
        want[r["k"], r["kind"]] = min(d, want.get((r["k"], r["kind"]), d))
    for k, found in got.items():
        assert found == pytest.approx([want[k, kind] for kind in ("River", "Lake", "Coast")], abs=1e-6)


def test_polygons_near(spark):
    edges = spark.createDataFrame(ring(1, [(0, 0), (10, 0), (10, 10), (0, 10)]) + ring(2, [(12, 0), (13, 0), (13, 1), (12, 1)]), EDGE)
    sites = spark.createDataFrame([(1, 5.0, 5.0), (2, 11.0, 0.5), (3, 11.0, 5.0), (4, 30.0, 30.0)], "s long, x double, y double")
    got = sorted((r["s"], r["basin_id"]) for r in pg.polygons_near(sites, edges, 1.0, "s").collect())
    assert got == [(1, 1), (2, 1), (2, 2), (3, 1)]


def test_polygons_near_broadcasts_no_list_of_cells(spark):
    edges = spark.createDataFrame(ring(1, [(0, 0), (10, 0), (10, 10), (0, 10)]), EDGE)
    plan = pg.polygons_near(spark.createDataFrame([(1, 5.0, 5.0)], "s long, x double, y double"), edges, 1.0, "s")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin [_cx") >= 2


def test_polygons_near_equals_brute_force(spark):
    rng = random.Random(8)
    polys = {b: star(b, rng.uniform(-9, 9), rng.uniform(-9, 9), rng.uniform(0.2, 2), 9, rng) for b in range(60)}
    sites = [(i, rng.uniform(-10, 10), rng.uniform(-10, 10)) for i in range(40)] + [(99, 4.0, 4.0)]
    edges = spark.createDataFrame([e for p in polys.values() for e in p], EDGE)
    for radius in (0.05, 1.0, 6.0):
        got = {(r["s"], r["basin_id"]) for r in pg.polygons_near(spark.createDataFrame(sites, "s long, x double, y double"), edges, radius, "s").collect()}
        assert got == {(i, b) for i, x, y in sites for b, p in polys.items() if inside(x, y, p) or min(seg_dist(x, y, *e[2:]) for e in p) <= radius}


def test_polygons_near_exchanges_no_pairs(spark, monkeypatch):
    """Crowded tiles, an id at two places, a row twice, a polygon without id, one that holds sites far from its edges, edges on borders of tiles."""
    monkeypatch.setattr(pg, "SITES_PER_TASK", 6)
    rng = random.Random(12)
    polys = {b: star(b, rng.uniform(-9, 9), rng.uniform(-9, 9), rng.uniform(0.2, 2), 9, rng) for b in range(50)}
    polys |= {100: ring(100, [(-30, -30), (30, -30), (30, 30), (-30, 30)]), None: ring(None, [(4, 4), (8, 4), (8, 8), (4, 8)])}
    sites = [(i, rng.uniform(-10, 10), rng.uniform(-10, 10)) for i in range(60)] + [(99, 4.0, 4.0), (99, 4.5, 4.0), (98, 8.0, 8.0), (98, 8.0, 8.0), (97, None, 1.0), (96, 70.0, 70.0)]
    edges = spark.createDataFrame([e for p in polys.values() for e in p] + polys[7], EDGE)
    points = spark.createDataFrame(sites, "s long, x double, y double")
    for radius in (1.0, 5.0):
        got = [(r["s"], r["basin_id"]) for r in pg.polygons_near(points, edges, radius, "s").collect()]
        want = {(i, b) for i, x, y in sites if x is not None for b, p in polys.items() if inside(x, y, p) or min(seg_dist(x, y, *e[2:]) for e in p) <= radius}
        assert len(got) == len(set(got)) and set(got) == want
    plan = pg.polygons_near(points.filter("s < 90"), edges, 1.0, "s")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan[: plan.index("MapInArrow")]


SHAPES = {
    1: ring(1, [(0, 0), (4, 0), (4, 4), (0, 4)]) + ring(1, [(1, 1), (3, 1), (3, 3), (1, 3)], 1),  # a hole: 12
    2: ring(2, [(3, 3), (9, 3), (3, 9)]),  # over a corner of 1: 18
    3: ring(3, [(10, 0), (12, 5), (14, 0), (12, 1)]) + ring(3, [(20, 0), (21, 0), (21, 1), (20, 1)], 1),  # an arrow and a far part
    4: ring(4, [(0, 20), (1, 20), (1, 20), (0, 20)]),  # no area
}


def test_trapezoids_have_the_area_and_lie_inside(spark):
    rng = random.Random(9)
    polys = SHAPES | {10 + b: star(10 + b, rng.uniform(-5, 5), rng.uniform(-5, 5), rng.uniform(0.1, 4), 40, rng) for b in range(6)}
    got = sm.trapezoids(spark.createDataFrame([e for p in polys.values() for e in p], EDGE)).collect()
    for b, edges in polys.items():
        own = [t for t in got if t["id"] == b]
        area = sum((t["right1"] - t["left1"] + t["right2"] - t["left2"]) / 2 * (t["y2"] - t["y1"]) for t in own)
        rings = {}
        for e in edges:
            rings[e[1]] = rings.get(e[1], 0) + (e[2] * e[5] - e[4] * e[3]) / 2
        want = abs(rings[0]) - sum(abs(a) for r, a in rings.items() if r) if b != 3 else abs(rings[0]) + abs(rings[1])
        assert area == pytest.approx(want, abs=1e-9)
        for t in own:
            middle = (t["left1"] + t["left2"] + t["right1"] + t["right2"]) / 4, (t["y1"] + t["y2"]) / 2
            assert t["right1"] + t["right2"] - t["left1"] - t["left2"] < 1e-9 or inside(*middle, edges)


def test_random_points_are_uniform_and_never_short(spark):
    edges = spark.createDataFrame([e for p in SHAPES.values() for e in p], EDGE)
    rows = lambda d, n: sorted(tuple(r) for r in sm.random_points_in_polygons(spark, d, n, 5).select("draw", "x", "y", "basin_id").collect())
    got = rows(edges, 6000)
    assert [r[0] for r in got] == list(range(6000)) and got == rows(edges.repartition(7), 6000)
    assert all(inside(x, y, SHAPES[b]) for _, x, y, b in got)
    areas = {1: 12.0, 2: 18.0, 3: 9.0}
    for b, area in areas.items():
        share = area / sum(areas.values())
        assert sum(r[3] == b for r in got) == pytest.approx(6000 * share, abs=5 * math.sqrt(6000 * share))
    # within the triangle the share below a line is that of its area there
    own = [(x, y) for _, x, y, b in got if b == 2]
    for low in (4, 5, 7):
        for value in (sum(p[0] < low for p in own), sum(p[1] < low for p in own)):
            share = 1 - ((9 - low) / 6) ** 2
            assert value == pytest.approx(len(own) * share, abs=5 * math.sqrt(len(own) * 0.25))


def test_draws_of_groups_use_their_own_polygons(spark, monkeypatch):
    monkeypatch.setattr(sm, "PIECE", 64)
    edges = spark.createDataFrame([(g, *e) for g, ids in (("a", (1,)), ("b", (2, 3)), ("flat", (4,))) for b in ids for e in SHAPES[b]], "grp string, " + EDGE)
    sizes = spark.createDataFrame([("a", 200, 3), ("b", 301, 4), ("none", 0, 1), ("flat", 5, 1)], "grp string, n long, seed int")
    draws = sm.grouped_draws(sizes, ["grp"])
    assert sorted((r["grp"], r["n"], r["most"]) for r in draws.groupBy("grp").agg(F.count("*").alias("n"), F.max("draw").alias("most")).collect()) == [("a", 200, 199), ("b", 301, 300), ("flat", 5, 4)]
    got = sm.points_in_areas(sm.area_index(edges, keys=["grp"]), draws, "seed", keys=["grp"]).collect()
    assert sorted({(r["grp"], r["basin_id"]) for r in got}) == [("a", 1), ("b", 2), ("b", 3)] and len(got) == 501
    with pytest.raises(ValueError, match="no area"):
        sm.random_points_in_polygons(spark, spark.createDataFrame(SHAPES[4], EDGE), 5, 1)


def test_reproducible_first_does_not_depend_on_partitions(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    pick = lambda d: sorted(r["k"] for r in sm.reproducible_first(d, "k", 777, 3).collect())
    a, b = pick(df.repartition(1)), pick(df.repartition(16))
    assert a == b and len(a) == 777
    with pytest.raises(Exception, match="fewer than 30000 rows"):
        sm.reproducible_first(df, "k", 30_000, must_fill=True).collect()


def test_disk_points_stay_in_disk(spark):
    sites = spark.createDataFrame([(1, 10.0, 20.0), (2, -5.0, 0.0)], "s long, x double, y double")
    got = sm.disk_points(sites, "s", 200, 3.0, 1).join(sites, "s").select(F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y")).alias("r"))
    radii = [r["r"] for r in got.collect()]
    assert len(radii) == 400 and max(radii) <= 3.0 and sum(r > 3 / math.sqrt(2) for r in radii) > 150


def test_draws_are_made_by_several_tasks(spark):
    sizes = spark.createDataFrame([("a", 30 * sm.PIECE), ("b", 5), ("c", 0)], "grp string, n long")
    tasks = sm.grouped_draws(sizes, ["grp"]).groupBy("grp", F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["grp"] == "a" for r in tasks) > 1
    assert {g: sum(r["count"] for r in tasks if r["grp"] == g) for g in "abc"} == {"a": 30 * sm.PIECE, "b": 5, "c": 0}
