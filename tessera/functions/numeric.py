from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(left: Column, right: Column, whole: bool) -> Column:
    """left / right, cut towards zero for whole numbers; null where right is 0."""
    right = F.nullif(right, F.lit(0))
    return F.call_function("div", left, right) if whole else F.try_divide(left, right)


def integer_average(value: Column) -> Column:
    """Average of a group's whole numbers, cut towards zero; nulls don't count."""
    return F.call_function("div", F.sum(value), F.nullif(F.count(value), F.lit(0)))


def unique_value(value: Column) -> Column:
    """The one value that all rows of a group have, or else null; also if one is null."""
    low = F.min(value)
    return F.when((F.count(F.lit(1)) == F.count(value)) & (low == F.max(value)), low)


def all_true(value: Column) -> Column:
    """Whether no value of a group is false; true for a group of nulls."""
    return F.coalesce(F.bool_and(value), F.lit(True))
