"""Readers, writers and cached tables."""
