from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import all_true, integer_average, unique_value
from tessera.plans.exprs import Agg, Alias, DynCol, Expr
from tessera.plans.resolve import Resolver, family_columns, is_whole, quoted
from tessera.plans.validate import check_aggregates


def _value(func: str, value: Column, whole: bool) -> Column:
    match func:
        case "sum":
            return F.sum(value)
        case "min":
            return F.min(value)
        case "max":
            return F.max(value)
        case "count":
            return F.count(F.lit(1))  # rows, nulls included
        case "avg":
            return integer_average(value) if whole else F.avg(value)
        case "unique":
            return unique_value(value)
    return all_true(value)


def _columns(e: Expr, df: DataFrame, types: Resolver) -> list[Column]:
    name, agg = (e.to, e.inner) if isinstance(e, Alias) else (None, e)
    if isinstance(agg.inner, DynCol):
        found = family_columns(df, agg.inner.family)
        return [_value(agg.func, quoted(c), is_whole(types.types[c])).alias(f"{agg.func}({c})") for c in found]
    whole = agg.func == "avg" and is_whole(types.data_type(agg.inner))
    return [_value(agg.func, types.scalar(agg.inner), whole).alias(name or agg.name)]


def aggregate(df: DataFrame, aggs: Sequence[Agg | Alias], groups: Sequence[Expr] = ()) -> DataFrame:
    """Groups, then aggregates; a family among either stands for all its columns. Null is a group like others.

    A group that the frame lacks is left out; an aggregate of a missing column is an error.
    """
    check_aggregates(list(aggs), df)
    types = Resolver(df)
    keys = [c for e in groups for c in types.columns(e)]
    return df.groupBy(*keys).agg(*(c for e in aggs for c in _columns(e, df, types)))
