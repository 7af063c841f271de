"""Whole analyses from input paths, on fixture views written to disk."""

import os

import pytest

from catchmark import fixtures
from catchmark.plans import distance, pathways, regimes, regions, stress

SF_DIR = os.environ.get("CATCHMARK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("inputs")

    def write(name, df):
        path = str(root / name)
        df.write.parquet(path)
        return path

    fac = fixtures.view(spark, SF_DIR, "facilities").withColumnsRenamed({"lon": "Longitude", "lat": "Latitude"})
    paths = {s: write(f"points_{s}", fac.filter(f"sector = '{s}'").drop("sector")) for s in ("AI", "Power", "TRI")}
    for name in ("basins", "basin_edges", "stress", "reaches", "streamflow", "pathways", "region_edges"):
        paths[name] = write(name, fixtures.view(spark, SF_DIR, name))
    return paths


def points(paths):
    return {s: paths[s] for s in ("AI", "Power", "TRI")}


def test_stress_analysis(spark, inputs, tmp_path):
    out = str(tmp_path / "stress")
    got = stress.run(spark, points(inputs), inputs["basins"], inputs["basin_edges"], inputs["stress"], out, reference_n=2_000)
    rows = got["direct_comparison"].collect()
    assert {r["Sector"] for r in rows} == {"AI", "Power", "TRI"}
    assert sum(r["Total"] for r in rows) == got["facilities_with_stress"].count()
    assert got["reference_with_stress"].count() <= 2_000
    assert spark.read.option("header", True).csv(f"{out}/sector_vs_reference").count() == 3


def test_regime_analysis(spark, inputs, tmp_path):
    out = str(tmp_path / "regimes")
    args = (spark, points(inputs), inputs["basins"], inputs["basin_edges"], inputs["reaches"], inputs["streamflow"], out)
    got = regimes.run(*args, start="1995-01-01", end="2001-12-31")
    assert got["presence"].count() == fixtures.view(spark, SF_DIR, "basins").count()
    master = got["master"]
    assert 0 < master.count() <= got["selected_reaches"].count()
    assert master.filter("RBI is null").count() == 0


def test_pathways(spark, inputs):
    rows = pathways.run(spark, inputs["pathways"]).collect()
    assert len(rows) == 15 and {r["pos"] for r in rows} == {1, 2, 3, 4, 5}


def test_missing_inputs_are_named_together(spark, inputs, tmp_path):
    with pytest.raises(FileNotFoundError, match="gone_a.*gone_b"):
        stress.run(spark, points(inputs), "/gone_a", inputs["basin_edges"], "/gone_b", str(tmp_path))


def test_other_parameters_are_computed_anew(spark, inputs, tmp_path):
    out = str(tmp_path / "stress")
    args = (spark, points(inputs), inputs["basins"], inputs["basin_edges"], inputs["stress"], out)
    few, more = (stress.run(*args, reference_n=n)["reference_with_stress"].count() for n in (300, 600))
    assert few <= 300 < more <= 600


def test_matched_stress_analysis(spark, inputs, tmp_path):
    # the smallest table leaves the other sectors without a site in some class
    got = stress.run_matched(spark, {"TRI": inputs["TRI"]}, inputs["basins"], inputs["basin_edges"], inputs["stress"], str(tmp_path))
    assert {mode: [r["Sector"] for r in table.collect()] for mode, table in got.items()} == {"GLOBAL": ["TRI"], "BASIN_MATCHED": ["TRI"]}


def test_regional_analysis(spark, inputs, tmp_path):
    got = regions.run(spark, points(inputs), inputs["basin_edges"], inputs["region_edges"], str(tmp_path))
    report = {r["sector"]: r for r in got["filter_report"].collect()}
    totals = {r["sector"]: r["total"] for r in got["shares"].collect()}
    assert totals == {s: r["after"] for s, r in report.items()} and set(report) == {"AI", "Power", "TRI"}


def test_distance_analysis(spark, tmp_path):
    view, paths = fixtures.view(spark, SF_DIR, "distances"), {}
    for sector in ("AI", "Power", "TRI"):
        for group in ("sector", "random"):
            paths[sector, group] = str(tmp_path / f"{sector}_{group}")
            view.filter(f"sector = '{sector}' AND grp = '{group}'").select("dist_river_km", "dist_lake_km", "dist_coast_km").write.parquet(paths[sector, group])
    got = distance.run(spark, paths, str(tmp_path / "out"))
    assert set(got) == {"dist_river_km", "dist_lake_km", "dist_coast_km", "dist_any_km"}
    assert [r["Sector"] for r in got["dist_any_km"].collect()] == ["AI", "Power", "TRI"]
