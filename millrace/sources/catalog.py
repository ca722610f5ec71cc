"""The typed catalog: tables, their columns, layouts and files; JSON and text forms."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BindError
from ..functions.expressions import quoted
from ..plans import syntax as S
from ..plans.estimator import Statistics
from . import files
from .layouts import Layout
from .text import Schema, read_table, write_table

SPARK_TYPES = {S.INT: "bigint", S.DOUBLE: "double", S.STRING: "string"}


def kind_of_type(kind: T.DataType) -> str | None:
    """The dialect's type of a Spark type; None if it has none."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return S.INT
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return S.DOUBLE
    return S.STRING if isinstance(kind, T.StringType) else None


@dataclass
class Table:
    name: str
    columns: Schema
    path: str = ""
    layout: str = "heap"
    sort_by: tuple[str, ...] = ()
    #: Folder of the contents before the last load; those who read it may go on until the next one.
    former: str = ""
    view: DataFrame | None = field(default=None, compare=False, repr=False)

    def rows(self, spark: SparkSession) -> DataFrame:
        if self.view is not None:
            return self.view
        return spark.read.schema(", ".join(f"`{n}` {SPARK_TYPES[k]}" for n, k in self.columns)).parquet(self.path)

    @property
    def stored_as(self) -> Layout:
        return Layout(self.layout, tuple(self.sort_by) or ((self.columns[0][0],) if self.layout == "tree" else ()))


class Catalog:
    """Tables by name, and the statistics of created ones. With a root folder, created
    tables live there and all of it is kept in catalog.json, which changes in one step."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root, self.statistics = spark, root.rstrip("/") if root else None, Statistics()
        self.tables: dict[str, Table] = {}
        self.promised: dict[str, Callable[[], DataFrame]] = {}
        if self.root and files.exists(spark, self._file):
            kept = json.loads(files.read_text(spark, self._file))
            for x in kept["tables"]:
                self.tables[x["name"]] = Table(x["name"], [tuple(c) for c in x["columns"]], x["path"], x["layout"], tuple(x["sort_by"]), x["former"])
            self.statistics = Statistics.read(kept["statistics"])

    @property
    def _file(self) -> str:
        return f"{self.root}/catalog.json"

    def _save(self) -> None:
        if self.root:
            kept = [t for t in self.tables.values() if t.view is None]
            tables = [{k: v for k, v in asdict(_bare(t)).items() if k != "view"} for t in kept]
            own = Statistics(self.statistics, only={t.name for t in kept})
            files.write_text(self.spark, self._file, json.dumps({"tables": tables, "statistics": own.write()}, indent=1))

    def __contains__(self, name: str) -> bool:
        return name in self.tables or name in self.promised

    def table(self, name: str) -> Table:
        if name in self.promised:
            self.register(name, self.promised.pop(name)())
        if name not in self.tables:
            raise BindError(f"no table {name}")
        return self.tables[name]

    def promise(self, name: str, read: Callable[[], DataFrame]) -> None:
        """A table over a DataFrame that is made when it is first asked for."""
        self.tables.pop(name, None)
        self.promised[name] = read

    def collect_statistics(self, name: str, exact: bool = False) -> None:
        """Counts the table's tuples and each column's distinct values, in one pass."""
        self.statistics.collect(name, self.table(name).rows(self.spark), exact)
        self._save()

    def register(self, name: str, df: DataFrame) -> Table:
        """A table over a DataFrame. Dates and timestamps show as text, year-month-day;
        columns of other types without a counterpart are left out."""
        columns, shown = [], []
        for f in df.schema:
            if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                columns.append((f.name, S.STRING))
                shown.append(F.date_format(quoted(f.name), "yyyy-MM-dd").alias(f.name))
            elif kind := kind_of_type(f.dataType):
                columns.append((f.name, kind))
                shown.append(quoted(f.name))
        self.tables[name] = Table(name, columns, view=df.select(*shown))
        return self.tables[name]

    def create(self, name: str, columns: Schema, layout: str = "heap", sort_by: tuple[str, ...] = ()) -> bool:
        """An empty table; False, without any change, if there is one of that name."""
        if name in self:
            return False
        if not self.root:
            raise BindError("tables can be created only in a session with a root folder")
        known = {c for c, _ in columns}
        if len(known) < len(columns):
            raise BindError("a column is named twice")
        if wrong := [c for c in sort_by if c not in known]:
            raise BindError(f"no column {wrong[0]} to sort on")
        table = Table(name, list(columns), self._folder(name), layout, tuple(sort_by))
        empty = self.spark.createDataFrame([], ", ".join(f"`{n}` {SPARK_TYPES[k]}" for n, k in columns))
        empty.write.mode("overwrite").parquet(table.path)
        self.tables[name] = table
        self.statistics.clear(name, [c for c, _ in columns])
        self._save()
        return True

    def _folder(self, name: str) -> str:
        return f"{self.root}/{name}/{uuid.uuid4().hex}"

    def replace(self, name: str, df: DataFrame) -> None:
        """Bulk load: the rows become the table's whole contents, and are counted.

        The contents before stay until the next load, for those who read them.
        """
        table = self.table(name)
        if table.view is not None:
            raise BindError(f"{name} is a view")
        path, gone = self._folder(name), table.former
        table.stored_as.write(df, path)
        table.path, table.former = path, table.path
        self.collect_statistics(name)
        if gone:
            files.delete(self.spark, gone)

    def drop(self, name: str) -> None:
        table = self.table(name)
        del self.tables[name]
        self.statistics.drop(name)
        self._save()
        if table.view is None:
            files.delete(self.spark, f"{self.root}/{name}")

    def open_text(self, path: str) -> list[str]:
        """Takes up the tables of a text-form catalog whose files are delimited text beside it; their names."""
        folder, found = path.rpartition("/")[0] or ".", from_text(files.read_text(self.spark, path))
        for t in found:
            place = t.path if "/" in t.path else f"{folder}/{t.path}"
            self.register(t.name, read_table(self.spark, place, t.columns))
        return [t.name for t in found]

    def save_text(self, path: str, names: list[str] | None = None) -> None:
        """Writes the text form of the named tables, or all, and their rows as delimited text beside it."""
        tables = [self.table(n) for n in (sorted([*self.tables, *self.promised]) if names is None else names)]
        folder = path.rpartition("/")[0] or "."
        for t in tables:
            write_table(t.rows(self.spark), f"{folder}/{t.name}.tbl", t.columns)
        files.write_text(self.spark, path, to_text([Table(t.name, t.columns) for t in tables]))


def _bare(table: Table) -> Table:
    return Table(table.name, table.columns, table.path, table.layout, table.sort_by, table.former)


def to_text(tables: list[Table]) -> str:
    """The text form: a block of name, file and typed columns for each table."""
    return "\n".join("\n".join(["BEGIN", t.name, t.path or f"{t.name}.tbl", *(f"{n} {k}" for n, k in t.columns), "END", ""]) for t in tables)


def from_text(text: str) -> list[Table]:
    """Tables of the text form, heaps all."""
    found, lines = [], None
    for line in map(str.strip, text.splitlines()):
        if line == "BEGIN":
            lines = []
        elif line == "END" and lines is not None:
            columns = [tuple(x.split()) for x in lines[2:]]
            if wrong := [k for _, k in columns if k not in SPARK_TYPES]:
                raise BindError(f"{wrong[0]} is no type")
            found.append(Table(lines[0], columns, lines[1]))
            lines = None
        elif line and lines is not None:
            lines.append(line)
    return found
