"""Choices where the dialect's intention and the behaviour of old programs differ."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """The defaults follow the language's intention; COMPATIBLE follows old programs."""

    #: Output columns of a list come last first.
    reversed_columns: bool = False
    #: SELECT DISTINCT, and SUM DISTINCT without GROUP BY, ignore DISTINCT.
    ignore_distinct: bool = False
    #: SUM DISTINCT with GROUP BY gives the sum alone.
    distinct_sum_alone: bool = False
    #: Columns beside a SUM without GROUP BY are ignored; otherwise they are an error.
    ignore_columns: bool = False
    #: An Int may be compared with a Double.
    coerce: bool = False
    #: Keywords in lower case count too.
    any_case: bool = False


COMPATIBLE = Options(reversed_columns=True, ignore_distinct=True, distinct_sum_alone=True, ignore_columns=True)
