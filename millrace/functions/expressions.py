"""Expressions and predicates as Spark columns, with the dialect's strict types."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BindError
from ..plans import syntax as S

Types = dict[str, str]


def quoted(name: str) -> Column:
    """A column whose name may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(node: S.Operand, types: Types) -> str:
    if isinstance(node, S.Literal):
        return node.kind
    if node.name not in types:
        raise BindError(f"no column {node.name}")
    return types[node.name]


def arithmetic(node: S.Expression, types: Types) -> tuple[Column, str]:
    """The column and its type. Integers are 64 bits wide before any operation;
    division of integers cuts towards zero; one Double makes both sides Double.
    Division by zero raises, as Spark's ANSI mode does."""
    if isinstance(node, S.Negative):
        value, kind = arithmetic(node.operand, types)
        return -value, kind
    if isinstance(node, S.Binary):
        (left, a), (right, b) = arithmetic(node.left, types), arithmetic(node.right, types)
        if a == b == S.INT:
            if node.op == "/":
                return F.call_function("div", left, right), S.INT
            return _OPERATORS[node.op](left, right), S.INT
        return _OPERATORS[node.op](left.cast("double"), right.cast("double")), S.DOUBLE
    kind = kind_of(node, types)
    if kind == S.STRING:
        raise BindError(f"{node} is a string; sums take numbers")
    value = F.lit(node.value) if isinstance(node, S.Literal) else quoted(node.name)
    return value.cast("bigint" if kind == S.INT else "double"), kind


_OPERATORS = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv}
_COMPARISONS = {"<": operator.lt, ">": operator.gt, "=": operator.eq}


def comparison(node: S.Comparison, types: Types, coerce: bool = False) -> Column:
    """Both sides have one type, unless `coerce` lets an Int meet a Double."""
    a, b = kind_of(node.left, types), kind_of(node.right, types)
    if a != b and not (coerce and {a, b} == {S.INT, S.DOUBLE}):
        raise BindError(f"{node}: {a} and {b} don't compare")
    left, right = (F.lit(x.value) if isinstance(x, S.Literal) else quoted(x.name) for x in (node.left, node.right))
    return _COMPARISONS[node.op](left, right)


def disjunction(term: S.Any, types: Types, coerce: bool = False) -> Column:
    return functools.reduce(operator.or_, (comparison(c, types, coerce) for c in term))


def conjunction(terms: S.All, types: Types, coerce: bool = False) -> Column:
    return functools.reduce(operator.and_, (disjunction(t, types, coerce) for t in terms))
