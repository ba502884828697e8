"""Cube analytics on Spark: a semantic layer over flat tables and star schemas."""
