"""Catalog data jobs as PySpark DataFrame transformations."""
