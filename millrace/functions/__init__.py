"""Arithmetic and predicates as Spark columns."""
