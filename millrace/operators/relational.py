"""The operators: each takes DataFrames and gives one, and nothing runs before an action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Types, arithmetic, conjunction, quoted
from ..plans import syntax as S
from ..plans.parser import parse_expression, parse_predicate
from ..sources.catalog import kind_of_type


def types_of(df: DataFrame) -> Types:
    """The dialect's types of a DataFrame's columns."""
    return {f.name: kind for f in df.schema if (kind := kind_of_type(f.dataType))}


def _predicate(condition: str | S.All | Column | None, types: Types) -> Column | None:
    if isinstance(condition, str):
        condition = parse_predicate(condition)
    return conjunction(condition, types) if isinstance(condition, tuple) else condition


def _expression(expression: str | S.Expression) -> S.Expression:
    return parse_expression(expression) if isinstance(expression, str) else expression


def scan(df: DataFrame, alias: str) -> DataFrame:
    """Columns under their qualified names, so that a table can meet itself."""
    return df.select(*(quoted(c).alias(f"{alias}.{c}") for c in df.columns))


def select_pipe(df: DataFrame, condition: str | S.All | Column) -> DataFrame:
    """Rows that a predicate of the dialect, or a column, holds for."""
    return df.where(_predicate(condition, types_of(df)))


def select_file(df: DataFrame, alias: str, condition: str | S.All | Column | None = None) -> DataFrame:
    """A scan with a filter; names in the predicate are qualified."""
    rows = scan(df, alias)
    return rows if condition is None else select_pipe(rows, condition)


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns by name, in this order."""
    return df.select(*map(quoted, columns))


def join(left: DataFrame, right: DataFrame, condition: str | S.All | Column | None = None) -> DataFrame:
    """An inner join, left columns first. Equalities make it a hash or sort-merge
    join, other conditions are tested on the pairs; without any it is the product."""
    found = _predicate(condition, types_of(left) | types_of(right))
    return left.crossJoin(right) if found is None else left.join(right, found, "inner")


def duplicate_removal(df: DataFrame) -> DataFrame:
    return df.distinct()


def sum_(df: DataFrame, expression: str | S.Expression, types: Types | None = None) -> DataFrame:
    """One row, SUM; 0 over no rows."""
    value, kind = arithmetic(_expression(expression), types or types_of(df))
    return df.agg(F.coalesce(F.sum(value), F.lit(0).cast("bigint" if kind == S.INT else "double")).alias("SUM"))


def group_by(df: DataFrame, expression: str | S.Expression, keys: list[str], types: Types | None = None) -> DataFrame:
    """SUM and the keys, a row for each group."""
    value, _ = arithmetic(_expression(expression), types or types_of(df))
    grouped = df.groupBy(*map(quoted, keys)).agg(F.sum(value).alias("SUM"))
    return grouped.select("SUM", *map(quoted, keys))


def sort(df: DataFrame, columns: list[str]) -> DataFrame:
    """All rows in ascending order; strings by their bytes. Spills as it must."""
    return df.orderBy(*(quoted(c).asc() for c in columns))


def default_order(df: DataFrame) -> list[str]:
    """All columns: integers, then doubles, then strings, each in the order of the table."""
    types = types_of(df)
    return [c for kind in (S.INT, S.DOUBLE, S.STRING) for c in df.columns if types.get(c) == kind]


def write_out(df: DataFrame, path: str) -> None:
    """Delimited text, a line for each row."""
    from ..sources.text import write_table

    write_table(df, path, list(types_of(df).items()))
