"""Water-supply pathway percentages per sector, in the fixed class order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catchmark.sources.readers import check_inputs, read_table, select_pathways


def run(spark: SparkSession, path: str) -> DataFrame:
    check_inputs(spark, [path])
    return select_pathways(read_table(spark, path))
