"""What a plan may not do, told before Spark sees it: Spark would cast instead."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .errors import PlanValidationError
from .exprs import AGGREGATES, COMPARISONS, LOGIC, TEXT_TESTS, Agg, Alias, Binary, Col, DynCol, Expr, IsNull, Lit, Not
from .resolve import Resolver, family_columns, is_whole


def _number(kind: T.DataType | None) -> bool:
    return kind is None or is_whole(kind) or isinstance(kind, (T.DoubleType, T.FloatType))


def filter_problems(e: Expr, types: Resolver) -> list[str]:
    if isinstance(e, Not):
        return filter_problems(e.inner, types)
    if isinstance(e, IsNull):
        return []
    if not isinstance(e, Binary):
        kind = types.data_type(e)
        return [] if kind is None or isinstance(kind, T.BooleanType) else [f"{e} is no condition"]
    if e.op in LOGIC:
        return filter_problems(e.left, types) + filter_problems(e.right, types)
    if e.op not in COMPARISONS + TEXT_TESTS:
        return [f"{e} is no condition"]
    if not any(isinstance(x, (Col, DynCol, Agg)) for x in e.left.walk()):
        return [f"the left side of {e} has no column"]
    if any(isinstance(x, DynCol) for x in e.left.walk()):
        return [f"the left side of {e} is a family; name one of its columns"]
    kind, value = types.data_type(e.left), e.right.value if isinstance(e.right, Lit) else None
    if e.op in TEXT_TESTS:
        if not isinstance(value, (str, bytes)):
            return [f"{e} needs a text on the right"]
        return [] if kind is None or isinstance(kind, (T.StringType, T.BinaryType)) else [f"{e} needs a text column"]
    times = (T.TimestampType, T.TimestampNTZType, T.DateType)
    if value is not None and isinstance(e.right, Lit) and kind is not None and isinstance(kind, times) != isinstance(value, date):
        return [f"{e} compares a time with something else"]
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if isinstance(kind, T.StringType) and (number or isinstance(value, bool)):
        return [f"{e} compares a text column with a {type(value).__name__}"]
    if kind is not None and (is_whole(kind) or isinstance(kind, T.DoubleType)) and isinstance(value, str):
        return [f"{e} compares a number column with a text"]
    return []


def aggregate_problems(e: Agg, types: Resolver) -> list[str]:
    if e.func not in AGGREGATES:
        return [f"there is no aggregate {e.func}"]
    if isinstance(e.inner, DynCol):
        kinds = [types.types[c] for c in family_columns(types.df, e.inner.family)]
        if not kinds:
            return [f"no column of {e.inner.family} to aggregate"]
    else:
        kinds = [types.data_type(e.inner)]
        if kinds == [None]:
            return [f"no column {e.inner} to aggregate"]
    if e.func == "and":
        return [] if all(isinstance(k, T.BooleanType) for k in kinds) else [f"{e} needs a boolean column"]
    return [] if all(map(_number, kinds)) else [f"{e} needs a number column"]


def check_filter(e: Expr, df: DataFrame) -> None:
    if problems := filter_problems(e, Resolver(df)):
        raise PlanValidationError("Filter", problems)


def check_aggregates(aggs: list[Expr], df: DataFrame) -> None:
    types, problems = Resolver(df), []
    for e in aggs:
        inner = e.inner if isinstance(e, Alias) else e
        problems += aggregate_problems(inner, types) if isinstance(inner, Agg) else [f"{e} is no aggregate"]
    if not aggs:
        problems.append("no aggregates")
    if problems:
        raise PlanValidationError("Aggregation", problems)
