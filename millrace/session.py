"""A session: a catalog, an output mode, and statements one after another."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .errors import BindError, EngineError
from .operators.relational import types_of
from .plans import syntax as S
from .plans.binder import bind
from .plans.estimator import cheapest_order
from .plans.explain import describe
from .plans.lowering import lower
from .plans.options import Options
from .plans.parser import parse
from .sources.catalog import Catalog
from .sources.text import console_line, read_table, write_table


class Session:
    """`root` is a folder for created tables, `data` the folder that INSERT reads from."""

    def __init__(self, spark: SparkSession, root: str | None = None, data: str = ".", options: Options = Options()):
        self.spark, self.data, self.options = spark, data.rstrip("/"), options
        self.catalog = Catalog(spark, root)
        self.output = "STDOUT"
        self.over = False

    def register(self, name: str, df: DataFrame) -> None:
        self.catalog.register(name, df)

    def register_folder(self, folder: str, names: list[str]) -> None:
        """Tables over the Parquet files <name>.parquet of a folder; a file is opened when its table is first used."""
        for name in names:
            self.catalog.promise(name, lambda name=name: self.spark.read.parquet(f"{folder}/{name}.parquet"))

    def analyze(self, name: str, exact: bool = False) -> None:
        """Collects the statistics of a table; INSERT does so by itself."""
        self.catalog.collect_statistics(name, exact)

    def query(self, text: str) -> DataFrame:
        """A SELECT as a DataFrame, whatever the output mode."""
        statement = parse(text, self.options.any_case)
        if not isinstance(statement, S.Select):
            raise BindError("this is no SELECT")
        return lower(bind(statement, self.catalog, self.options), self.catalog, self.spark, self.options)

    def explain(self, text: str) -> str:
        """The plan of a SELECT, with the cheapest order and its estimates where all tables have statistics; nothing runs."""
        statement = parse(text, self.options.any_case)
        if not isinstance(statement, S.Select):
            raise BindError("this is no SELECT")
        bound = bind(statement, self.catalog, self.options)
        order = cheapest_order(self.catalog.statistics, {t.alias: t.table for t in statement.tables}, statement.where)
        return describe(bound, self.options, order)

    def sql(self, text: str) -> DataFrame | str | None:
        """Runs one statement. A SELECT gives its rows, its plan (SET OUTPUT NONE) or
        None after writing a file; the others give a message or None."""
        statement = parse(text, self.options.any_case)
        match statement:
            case S.Select():
                if self.output == "NONE":
                    return self.explain(text)
                rows = self.query(text)
                if self.output == "STDOUT":
                    return rows
                write_table(rows, self.output, list(types_of(rows).items()))
                return None
            case S.CreateTable():
                made = self.catalog.create(statement.name, list(statement.columns), statement.layout, statement.sort_by)
                return None if made else f"table {statement.name} exists"
            case S.Insert():
                table = self.catalog.table(statement.table)
                self.catalog.replace(statement.table, read_table(self.spark, f"{self.data}/{statement.file}", table.columns))
                return None
            case S.DropTable():
                self.catalog.drop(statement.name)
                return None
            case S.SetOutput():
                self.output = statement.target
                return None
        self.over = True
        return None

    def run(self, text: str, show: Callable[[str], None] = print) -> None:
        """Runs one statement for a person: prints rows, plans, messages and errors."""
        try:
            found = self.sql(text)
            if isinstance(found, DataFrame):
                schema = list(types_of(found).items())
                # Partition after partition: all rows are shown, and one partition's are held.
                for row in found.toLocalIterator():
                    show(console_line(row, schema))
            elif found:
                show(found)
        except (EngineError, PySparkException, Py4JError) as e:
            show(f"{type(e).__name__}: {e}")
