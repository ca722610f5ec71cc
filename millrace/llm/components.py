"""Connected components by contraction, with stored tables between the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _pointed(edges: DataFrame) -> DataFrame:
    """node, to: each node's smallest neighbour if that is smaller, or else itself, two steps at once."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
    step = scratch.store(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")), "components-step")
    again = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
    return scratch.store(step.join(again, "to").select("node", F.col("next").alias("to")), "components-jump")


def _renamed(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    renamed = rows.join(names.select(F.col("node").alias(column), F.col("to").alias("renamed")), column, "left")
    return renamed.withColumn(column, F.coalesce("renamed", column)).drop("renamed")


def components(edges: DataFrame) -> DataFrame:
    """node, root for all nodes of `edges` (a, b): one root, a node's name, for each component.

    Each round joins every node to a smaller neighbour and renames the edges, so
    a component shrinks by half at least; edges are never gathered in one place.
    Repeated edges and loops don't matter; no edges give no rows.
    """
    edges = scratch.store(edges.select("a", "b").distinct(), "components-edges")
    names = None
    while True:
        to = _pointed(edges)
        names = to.select("node", F.col("to").alias("root")) if names is None else _renamed(names, "root", to).select("node", "root")
        names = scratch.store(names, "components-names")
        left = _renamed(_renamed(edges, "a", to), "b", to).where(F.col("a") != F.col("b"))
        edges = scratch.store(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "components-edges")
        if not edges.take(1):
            return names
