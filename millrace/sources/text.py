"""Delimited text: every field ends with a bar, nothing is quoted, blanks count.

The text has no nulls: a null is written as an empty field, which reads back as
an empty string or as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import quoted
from ..plans import syntax as S

Schema = list[tuple[str, str]]

#: The beginning of a field that is read as its number; without one it is 0.
NUMBERS = {S.INT: (r"^\s*([+-]?[0-9]+)", "bigint"), S.DOUBLE: (r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)", "double")}
#: Formats by type, with six decimals for doubles.
FORMATS = {S.INT: "%d", S.DOUBLE: "%f", S.STRING: "%s"}


def _field(text: Column, kind: str) -> Column:
    if kind == S.STRING:
        return text
    pattern, target = NUMBERS[kind]
    return F.coalesce(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast(target), F.lit(0).cast(target))


def from_lines(lines: DataFrame, schema: Schema) -> DataFrame:
    """Rows from a column `value` of lines; a line with too few bars is no row."""
    parts = F.split("value", r"\|", -1)
    whole = lines.select(parts.alias("parts")).where(F.size("parts") > len(schema))
    return whole.select(*(_field(F.col("parts")[i], kind).alias(name) for i, (name, kind) in enumerate(schema)))


def read_table(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    return from_lines(spark.read.text(path), schema)


def parse_rows(spark: SparkSession, lines: list[str], schema: Schema) -> DataFrame:
    """Rows from strings in memory."""
    return from_lines(spark.createDataFrame([(x,) for x in lines], "value string"), schema)


def to_lines(df: DataFrame, schema: Schema) -> DataFrame:
    fields = [F.when(quoted(name).isNull(), F.lit("")).otherwise(F.format_string(FORMATS[kind], quoted(name))) for name, kind in schema]
    return df.select(F.concat(F.concat_ws("|", *fields), F.lit("|")).alias("value"))


def write_table(df: DataFrame, path: str, schema: Schema) -> None:
    """One line for each row, in a folder of part files."""
    to_lines(df, schema).write.mode("overwrite").text(path)


def console_line(row, schema: Schema) -> str:
    """A row as the shell prints it: doubles with six significant digits."""
    return ", ".join(f"{name}: [{format(value, 'g') if kind == S.DOUBLE else value}]" for (name, kind), value in zip(schema, row))
