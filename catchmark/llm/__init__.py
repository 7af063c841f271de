"""Operators of a training-data pipeline: scans, filters, joins, codecs, mixing and extraction over documents, pages and vectors."""
