"""Statements: syntax tree, parser, binder, lowering to DataFrames, plan text, estimator."""
