"""Thinning a table before a join by a filter of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of the filter; this bounds what is broadcast.
SLOTS = 1 << 20


def thinned(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Rows that may have a partner in `wanted`: those in a slot of a hash that a wanted row fills.

    At most SLOTS numbers are broadcast, however many rows are wanted. The exact
    join comes after it and moves the less, the fewer slots are filled.
    """
    slot = F.pmod(F.xxhash64(column), F.lit(SLOTS)).alias("slot")
    filled = wanted.select(slot).distinct()
    return rows.withColumn("slot", slot).join(F.broadcast(filled), "slot", "left_semi").drop("slot")
