"""Catalog, table layouts, delimited text."""
