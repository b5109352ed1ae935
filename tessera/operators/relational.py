from __future__ import annotations

import secrets
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.errors import PlanValidationError
from tessera.plans.exprs import All, Expr
from tessera.plans.resolve import Resolver
from tessera.plans.validate import check_filter


#: Intervals of random numbers counted at a time.
_CELLS = 4096


def filter_rows(df: DataFrame, condition: Expr | None) -> DataFrame:
    """Rows of which the condition is true; all of them without one."""
    if condition is None:
        return df
    check_filter(condition, df)
    return df.where(Resolver(df).predicate(condition))


def project(df: DataFrame, exprs: Sequence[Expr]) -> DataFrame:
    """One column for each expression, more for a family, none for what the frame lacks; All() leaves the frame as it is."""
    if any(isinstance(e, All) for e in exprs):
        return df
    resolver = Resolver(df)
    return df.select(*(c for e in exprs for c in resolver.columns(e)))


def distinct(df: DataFrame, exprs: Sequence[Expr]) -> DataFrame:
    """Different rows of the projection: a partial aggregate in front of the shuffle, one after it."""
    return project(df, exprs).distinct()


def _row_count(n: object, what: str) -> int:
    if not isinstance(n, int) or isinstance(n, bool) or n < 0:
        raise PlanValidationError(what, [f"{n!r} is no number of rows"])
    return n


def limit(df: DataFrame, n: int) -> DataFrame:
    """n rows in all, whichever."""
    return df.limit(_row_count(n, "Limit"))


def sample(df: DataFrame, size: int, seed: int | None = None, byte_limit: int | None = None) -> DataFrame:
    """Exactly `size` rows (all, where there are fewer), every set of them as likely as any other.

    A random number orders the rows, and each task keeps the `size` smallest: memory is bounded by the sample. With a
    byte_limit no task keeps rows: the number below which the sample lies is found first, by counting; the rows are the same.
    """
    size = _row_count(size, "Sample")
    if byte_limit is None:
        return df.orderBy(F.rand(seed)).limit(size)
    drawn = "sample_" + "_".join(df.columns)[:40] + str(len(df.columns))  # no column's name: longer by a number
    while drawn in df.columns:
        drawn += "_"
    rows = df.withColumn(drawn, F.rand(secrets.randbits(31) if seed is None else seed))
    u, low, width, left = F.col(drawn), 0.0, 1.0, size
    for _ in range(2):
        inside = rows.where((u >= low) & (u < low + width))
        width /= _CELLS
        cells = inside.groupBy(F.floor((u - low) / width).alias("cell")).count().orderBy("cell").collect()  # _CELLS rows at most
        for cell, n in cells:
            if n >= left:
                low += cell * width
                break
            left -= n
        else:
            return df  # as many rows or fewer
    within = rows.where((u >= low) & (u < low + width)).orderBy(drawn).limit(left)
    return rows.where(u < low).unionAll(within).drop(drawn)


def schema_rows(df: DataFrame) -> DataFrame:
    """A row for each concrete column: name. Made within the JVM, from one row."""
    spark: SparkSession = df.sparkSession
    names = F.array(*map(F.lit, df.columns)).cast("array<string>")
    return spark.sql("SELECT 1 AS one").select(F.explode(names).alias("name"))
