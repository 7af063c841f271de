"""Registered queries on the small tables: results equal their SQL, and the driver contract holds.

Set CATCHMARK_ALL=1 to check every query (several minutes); CATCHMARK_SF_DIR picks other tables.
"""

import os

import pytest
from oracle_check import compare, connect

import __spark_entry__ as driver
from catchmark.catalog import all_queries

SF_DIR = os.environ.get("CATCHMARK_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = (
    "points_clean dist_values format_cells stress_dedup pip_left reach_map albers_xy nearest_ties random_in_basins presence_counts "
    "region_share tertiles wide_desc basin_metrics ecdf_rows bh_fdr chi2_direct tests_vs_random boot_with_repl"
).split()
NAMES = list(all_queries()) if os.environ.get("CATCHMARK_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    _, _, problem = compare(spark, con, SF_DIR, name, all_queries()[name])
    assert problem is None, problem


def test_driver_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() == 3
