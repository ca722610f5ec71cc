"""A bound SELECT as one DataFrame. Conditions stand where their columns are complete;
pushdown, pruning, join order and strategies are Catalyst's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.expressions import conjunction, quoted
from ..operators import relational as R
from ..sources.catalog import Catalog
from . import syntax as S
from .binder import Bound
from .options import Options


def lower(bound: Bound, catalog: Catalog, spark: SparkSession, options: Options = Options()) -> DataFrame:
    select, types = bound.select, bound.all_types
    rows: DataFrame | None = None
    for ref in select.tables:
        scan = R.scan(catalog.table(ref.table).rows(spark), ref.alias)
        if bound.own[ref.alias]:
            scan = scan.where(conjunction(bound.own[ref.alias], types, options.coerce))
        if rows is None:
            rows = scan
        else:
            terms = bound.joins[ref.alias]
            rows = R.join(rows, scan, conjunction(terms, types, options.coerce) if terms else None)
    if bound.constant:
        rows = rows.where(conjunction(bound.constant, {}, options.coerce))
    if select.sum is None:
        out = R.project(rows, list(bound.columns))
        return R.duplicate_removal(out) if select.distinct and not options.ignore_distinct else out
    distinct = select.sum.distinct and (bool(bound.group_by) or not options.ignore_distinct)
    if distinct:
        # The tuples of the argument's columns and the keys are what is distinct, not the argument's values.
        rows = rows.select(*(quoted(c) for c in dict.fromkeys([*S.columns_of(select.sum.expression), *bound.group_by]))).distinct()
    if not bound.group_by:
        return R.sum_(rows, select.sum.expression, types)
    out = R.group_by(rows, select.sum.expression, list(bound.group_by), types)
    kept = () if distinct and options.distinct_sum_alone else bound.columns
    return out.select("SUM", *(quoted(c) for c in kept))
