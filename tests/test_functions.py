"""Scalar functions against values computed by hand or by the Python standard library."""

import math

import pytest
from pyspark.sql import functions as F

from catchmark.functions import clean, geometry, tails, text
from catchmark.functions.columns import find_lat_lon_columns, pick_col, require_col, require_cols


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_pick_col_prefers_exact_in_key_order_then_first_substring_column():
    assert pick_col(["lat", "Latitude"], ["latitude", "lat"]) == "Latitude"
    assert pick_col(["Facility", "LAT_DEG"], ["latitude", "lat", "y"]) == "Facility"
    assert pick_col(["a", "b"], ["lat"]) is None


def test_find_lat_lon_takes_last_exact_match():
    assert find_lat_lon_columns(["lat", "Latitude", "x", " LONG "]) == ("Latitude", " LONG ")
    assert find_lat_lon_columns(["site_latitude", "belongs", "lon_dd"]) == ("site_latitude", "belongs")
    assert find_lat_lon_columns(["a"]) == (None, None)


def test_required_columns_raise():
    assert require_col(["LAT"], ["Latitude", "lat"]) == "LAT"
    with pytest.raises(ValueError):
        require_col(["a"], ["lat"])
    with pytest.raises(ValueError, match="missing|lacks"):
        require_cols(["a"], ["a", "b"], "table")


def test_to_number(spark):
    df = spark.createDataFrame([(" 12.5 ",), ("1e3",), ("x",), ("NaN",), (None,)], "s string")
    assert [r[0] for r in df.select(clean.to_number(F.col("s"))).collect()] == [12.5, 1000.0, None, None, None]


def test_zfill_and_percent_class(spark):
    df = spark.createDataFrame([("1",), ("001",)], "s string")
    assert [r[0] for r in df.select(clean.zfill(F.col("s"), 2)).collect()] == ["01", "001"]
    values = [0.0, 0.5, 1.0, 3.0, 10.0, 10.1, 101.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(clean.percent_class(F.col("v"))).collect()]
    assert got == ["0%", "0–1%", "0–1%", "1–3%", "6–10%", ">10%", "nan"]


def test_nearest_kind_tie_and_nulls(spark):
    df = spark.createDataFrame([(2.0, 2.0, 3.0), (None, 3.0, 5.0), (None, None, None)], "r double, l double, c double")
    kinds = {"River": F.col("r"), "Lake": F.col("l"), "Coast": F.col("c")}
    assert [r[0] for r in df.select(clean.nearest_kind(kinds)).collect()] == ["River", "Lake", None]


def test_keep_values_variants(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, -1.0, 2.0, float("nan"), float("inf"), None)], "v double")
    count = lambda *a, **k: clean.keep_values(df, "v", *a, **k).count()
    assert (count(), count(0.0, True), count(None)) == (2, 1, 4)


def test_number_text_follows_binary_value(spark):
    values = [0.125, 0.375, 2.675, 1.005, -0.0004, 0.1145, 1234.5, 1235.5, 999.999, 0.0, 12.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select(*[text.fixed(F.col("v"), d).alias(f"f{d}") for d in (1, 2, 3)], text.fmt_num(F.col("v"), 2).alias("n")).collect()
    for v, r in zip(values, rows):
        assert [r.f1, r.f2, r.f3] == [f"{v:.1f}", f"{v:.2f}", f"{v:.3f}"]
        assert r.n == (f"{v:,.0f}" if abs(v) >= 1000 else f"{v:.2f}")
    assert one(spark, text.fmt_num(F.lit(None).cast("double"))) == ""
    assert one(spark, text.fmt_median_iqr(F.lit(1.0), F.lit(0.5), F.lit(2.0))) == "1.000 [0.500, 2.000]"


def test_p_text(spark):
    values = {0.03: "0.030", 0.0005: "<0.001", 0.0: "<1e-4", 1.2e-05: "1.2e-05", 1e-12: "1e-12", 3.25e-100: "3.25e-100"}
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(text.fmt_p(F.col("v"))).collect()] == list(values.values())
    assert one(spark, text.fmt_p(F.lit(None).cast("double"))) == ""
    assert one(spark, text.fmt_p(F.lit("<1e-4"))) == "<1e-4"


def test_erfc_and_chi2_tails(spark):
    zs = [-3.0, -0.5, 0.0, 0.3, 1.0, 1.99, 2.0, 2.5, 4.0, 8.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for z, r in zip(zs, df.select(tails.erfc(F.col("z"))).collect()):
        assert r[0] == pytest.approx(math.erfc(z), rel=1e-12)
    assert one(spark, tails.chi2_sf(F.lit(16 / 3), F.lit(2))) == pytest.approx(0.0694834512, abs=1e-9)
    assert one(spark, tails.chi2_sf(F.lit(9.487729036781154), F.lit(4))) == pytest.approx(0.05, abs=1e-12)
    assert one(spark, tails.chi2_sf(F.lit(7.814727903251179), F.lit(3))) == pytest.approx(0.05, abs=1e-12)
    assert one(spark, tails.chi2_sf(F.lit(3.841458820694124), F.lit(1))) == pytest.approx(0.05, abs=1e-12)
    # 1.3581 is the tabulated 5% point of the limit law; both series agree where they meet
    assert one(spark, tails.kolmogorov_sf(F.lit(1.3580986))) == pytest.approx(0.05, abs=1e-6)
    assert one(spark, tails.kolmogorov_sf(F.lit(0.9999999))) == pytest.approx(one(spark, tails.kolmogorov_sf(F.lit(1.0))), abs=1e-6)


def test_albers_origin_and_known_point(spark):
    x, y = geometry.albers_xy(F.lit(-96.0), F.lit(23.0))
    assert one(spark, F.sqrt(x * x + y * y)) == pytest.approx(0.0, abs=1e-6)
    # equal area: a small square's projected area matches the ellipsoid's
    def at(lon, lat):
        px, py = geometry.albers_xy(F.lit(lon), F.lit(lat))
        return one(spark, px), one(spark, py)

    (ax, ay), (bx, by), (cx, cy) = at(-80.0, 40.0), at(-79.99, 40.0), at(-80.0, 40.01)
    area = abs((bx - ax) * (cy - ay) - (cx - ax) * (by - ay))
    e2 = geometry.GRS80_F * (2 - geometry.GRS80_F)
    s = math.sin(math.radians(40.005))
    m = geometry.GRS80_A * (1 - e2) / (1 - e2 * s * s) ** 1.5
    n = geometry.GRS80_A / math.sqrt(1 - e2 * s * s) * math.cos(math.radians(40.005))
    assert area == pytest.approx(m * n * math.radians(0.01) ** 2, rel=1e-4)


def test_utm(spark):
    assert one(spark, geometry.utm_epsg(F.lit(-80.8))) == 32617
    east, north = geometry.utm_xy(F.lit(-81.0), F.lit(0.0), F.lit(17))
    assert (one(spark, east), one(spark, north)) == (pytest.approx(500000.0), pytest.approx(0.0))
    # meridian arc from the equator to 45 degrees on WGS84 is 4984944.378 m
    _, north = geometry.utm_xy(F.lit(-81.0), F.lit(45.0), F.lit(17))
    assert one(spark, north) == pytest.approx(0.9996 * 4984944.378, abs=0.01)


def test_segment_distance(spark):
    df = spark.createDataFrame([(5.0, 3.0, 0.0, 10.0), (13.0, 4.0, 0.0, 10.0), (3.0, 4.0, 0.0, 0.0)], "px double, py double, x1 double, x2 double")
    d = geometry.segment_distance(F.col("px"), F.col("py"), F.col("x1"), F.lit(0.0), F.col("x2"), F.lit(0.0))
    assert [r[0] for r in df.select(d).collect()] == [3.0, 5.0, 5.0]


def test_bytes_of_doubles(spark):
    import random
    import struct

    from catchmark.functions.bits import double_bits, little_endian_hex, low_bytes

    rng = random.Random(6)
    values = [0.0, -0.0, 1.0, -1.0, 0.1, -96.5, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, 2.0**-1022, 0.9999999999999999, 1.0000000000000002]
    values += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64) & ~(1 << 62) | (rng.getrandbits(1) << 54)))[0] for _ in range(200)]
    values += [s * math.nextafter(2.0**k, t) for k in range(-40, 40, 7) for t in (0, 1e9, 2.0**k) for s in (1, -1)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None), (-2, float("nan")), (-3, float("inf"))], "i int, v double")
    got = {r["i"]: r for r in df.select("i", double_bits(F.col("v")).alias("b"), little_endian_hex(F.col("v")).alias("h"), low_bytes(F.col("v")).alias("low")).collect()}
    for i, v in enumerate(values):
        packed = struct.pack("<d", v)
        assert (got[i]["b"], got[i]["h"], got[i]["low"]) == (struct.unpack("<q", packed)[0], packed.hex().upper(), packed[0] * 256 + packed[1]), v
    assert all(got[i]["b"] is None and got[i]["h"] is None for i in (-1, -2, -3))


def test_first_points_by_their_bytes(spark):
    import random
    import struct

    from catchmark.operators.sampling import first_by_bytes

    rng = random.Random(2)
    points = [(i, rng.uniform(-120, -70), rng.uniform(25, 50)) for i in range(500)] + [(500 + i, float(-100 + i % 3), float(30 + i)) for i in range(40)]
    df = spark.createDataFrame([*points, (999, None, 1.0), (998, float("nan"), 2.0)], "i int, x double, y double").repartition(5)
    want = sorted(points, key=lambda p: struct.pack("<dd", p[1], p[2]).hex())
    for n in (1, 25, 300):
        assert {r["i"] for r in first_by_bytes(df, n).collect()} == {p[0] for p in want[:n]}
