"""Readers, writers and caches."""

import pytest
from pyspark.sql import functions as F

from catchmark.sources import readers
from catchmark.sources.writers import cached_table, resumed_table, write_csv


def test_points_csv_round_trip_and_forced_columns(spark, tmp_path):
    path = str(tmp_path / "tri.csv")
    raw = spark.createDataFrame(
        [(1, " 12.5 ", "40", "7"), (2, "x", "41", "7"), (3, "-80", "NaN", "7")], "id int, `13. LONGITUDE` string, `12. LATITUDE` string, City string"
    )
    write_csv(raw, path)
    rows = readers.load_points(spark, path, "TRI").collect()
    assert [(r["id"], r["lon"], r["lat"], r["sector"]) for r in rows] == [("1", 12.5, 40.0, "TRI")]


def test_missing_columns_and_inputs_raise(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    for check in (
        lambda: readers.clean_stress(df),
        lambda: readers.clean_distances(df),
        lambda: readers.clean_points(df, "AI"),
        lambda: readers.select_pathways(df),
    ):
        with pytest.raises(ValueError):
            check()
    with pytest.raises(FileNotFoundError, match="none_a.*none_b"):
        readers.check_inputs(spark, [str(tmp_path), f"{tmp_path}/none_a", f"{tmp_path}/none_b"])


def test_dist_any_is_derived_or_taken(spark):
    df = spark.createDataFrame([(None, "3", "5"), (None, None, None)], "dist_river_km string, dist_lake_km string, dist_coast_km string")
    assert [r["dist_any_km"] for r in readers.clean_distances(df).collect()] == [3.0, None]
    given = readers.clean_distances(df.withColumn("dist_any_km", F.lit("9")))
    assert [r["dist_any_km"] for r in given.collect()] == [9.0, 9.0]


def test_cached_table_is_reused_until_recompute(spark, tmp_path):
    path, built = str(tmp_path / "cache"), []

    def build(n):
        def run():
            built.append(n)
            return spark.range(n)

        return run

    assert cached_table(spark, path, build(3)).count() == 3
    assert cached_table(spark, path, build(5)).count() == 3
    assert cached_table(spark, path, build(5), recompute=True).count() == 5
    assert built == [3, 5]


def test_broken_run_goes_on_after_its_last_part(spark, tmp_path):
    path, asked = str(tmp_path / "metrics"), []
    rows = spark.range(200).selectExpr("id % 40 as k", "id as v")

    def build(stop_at=None):
        def run(some):
            own = sorted(r["k"] for r in some.collect())
            if stop_at is not None and len(asked) == stop_at:
                raise RuntimeError("lost")
            asked.append(own)
            return rows.join(some, "k").groupBy("k").agg(F.sum("v").alias("s"))

        return run

    def go(n, stop_at=None, **how):
        keys = spark.range(n).withColumnRenamed("id", "k")
        return {r["k"]: r["s"] for r in resumed_table(spark, path, keys, build(stop_at), parts=4, **how).collect()}

    want = {k: sum(range(k, 200, 40)) for k in range(40)}
    with pytest.raises(RuntimeError, match="lost"):
        go(30, stop_at=1)
    # the second part wrote rows but no manifest before it broke off
    spark.range(3).selectExpr("id as k", "-1 as s").write.parquet(f"{path}/generation-0/rows-1")
    assert len(asked) == 1
    assert go(30) == {k: want[k] for k in range(30)}
    assert sorted(k for own in asked for k in own) == list(range(30)) and len(asked) == 4
    assert go(30) == {k: want[k] for k in range(30)} and len(asked) == 4  # nothing is left
    assert go(45) == want and sorted(k for own in asked[4:] for k in own) == list(range(30, 45))  # only new keys, some of them without rows
    done = len(asked)
    assert go(45) == want and len(asked) == done
    assert go(10) == {k: want[k] for k in range(10)} and len(asked) == done
    assert go(10, recompute=True) == {k: want[k] for k in range(10)} and sorted(k for own in asked[done:] for k in own) == list(range(10))
    assert go(0) == {} and go(5, window=3) == {k: want[k] for k in range(5)}
