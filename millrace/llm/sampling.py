"""Bounded samples for fitting models: the same rows in every run, and few rows moved."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Part of the hash values that is kept, in rows expected, as a multiple of the bound.
SPARE = 4
_SCALE = 1 << 40


def bounded_sample(rows: DataFrame, bound: int, *keys: str) -> DataFrame:
    """At most `bound` rows: those with the smallest hashes of the key columns.

    A large table is thinned by the hash first, so that tasks don't each send
    `bound` rows to the one that chooses. Fewer rows than the bound can come only
    if most rows repeat a few keys.
    """
    n = rows.count()
    hashed = F.xxhash64(*keys)
    if n > 2 * SPARE * bound:
        rows = rows.where(F.pmod(hashed, F.lit(_SCALE)) < int(_SCALE * SPARE * bound / n))
    return rows.orderBy(F.pmod(hashed, F.lit(_SCALE)), *keys).limit(bound)


def bounded_in_groups(rows: DataFrame, bound: int, group: str, key: str) -> DataFrame:
    """At most `bound` rows of each group: those with the smallest hashes of the key.

    Groups far larger than the bound are thinned by the hash before they are ranked.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("_size"))
    hashed = F.pmod(F.xxhash64(key), F.lit(_SCALE))
    thin = rows.join(sizes, group).where((F.col("_size") <= 2 * SPARE * bound) | (hashed < F.lit(_SCALE * SPARE * bound) / F.col("_size"))).drop("_size")
    place = Window.partitionBy(group).orderBy(hashed, key)
    return thin.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= bound).drop("_place")
