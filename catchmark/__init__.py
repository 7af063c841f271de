"""Spatial statistics for facility siting and water, as PySpark DataFrame operators."""

SECTORS = ("AI", "Power", "TRI")
