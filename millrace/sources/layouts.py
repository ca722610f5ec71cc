"""How a table's files are laid out, and the access paths that follow from it.

A heap is files as they come. A sorted table is dealt by ranges of its sort
columns and sorted inside each file; a tree table likewise by its first column.
Row-group minima and maxima then play the index's part: an equality or a range on
the leading column reads the groups that can hold it and no others.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import quoted


@dataclass(frozen=True)
class Layout:
    kind: str = "heap"
    sort_by: tuple[str, ...] = field(default=())

    def arrange(self, df: DataFrame) -> DataFrame:
        if self.kind == "heap":
            return df
        keys = [quoted(c) for c in self.sort_by]
        return df.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def write(self, df: DataFrame, path: str) -> None:
        self.arrange(df).write.mode("overwrite").parquet(path)


def scan(spark: SparkSession, path: str, condition: Column | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if condition is None else rows.where(condition)


class KeyedTable:
    """Access by the leading column of a sorted or tree table. Keys may repeat.

    Changes write a new folder and return the table there; the old one stays
    for readers that have begun.
    """

    def __init__(self, spark: SparkSession, path: str, layout: Layout):
        if layout.kind == "heap":
            raise ValueError("a heap has no key")
        self.spark, self.path, self.layout = spark, path, layout
        self.key = quoted(layout.sort_by[0])

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def get(self, key) -> DataFrame:
        return self.rows().where(self.key == F.lit(key))

    def between(self, low, high, limit: int | None = None) -> DataFrame:
        """Rows with keys from low to high, both included; the `limit` smallest if given."""
        found = self.rows().where(self.key.between(F.lit(low), F.lit(high)))
        return found if limit is None else found.orderBy(self.key).limit(limit)

    def _rewritten(self, df: DataFrame, path: str) -> KeyedTable:
        self.layout.write(df, path)
        return KeyedTable(self.spark, path, self.layout)

    def insert(self, rows: DataFrame, path: str) -> KeyedTable:
        return self._rewritten(self.rows().unionByName(rows), path)

    def _others(self, key) -> DataFrame:
        """Rows of other keys, of the null key too."""
        return self.rows().where(~self.key.eqNullSafe(F.lit(key)))

    def remove(self, key, path: str) -> KeyedTable:
        return self._rewritten(self._others(key), path)

    def update(self, key, rows: DataFrame, path: str) -> KeyedTable:
        return self._rewritten(self._others(key).unionByName(rows), path)
