"""Expressions to Spark columns against a frame's schema: families expand, missing columns become constants or vanish."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import divide, floor_bucket

from .errors import PlanValidationError
from .exprs import ARITHMETIC, COMPARISONS, LOGIC, PREDICATES, Agg, Alias, All, Binary, Col, Convert, Duration, DynCol, Expr, If, IsNull, Lit, Not

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_COMPARE = {"==": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


def quoted(name: str) -> Column:
    """A column of exactly this name: a dot in it isn't a field's."""
    return F.col("`" + name.replace("`", "``") + "`")


def family_columns(df: DataFrame, family: str) -> list[str]:
    return sorted(c for c in df.columns if c.startswith(family + "."))


def is_whole(kind: T.DataType) -> bool:
    return isinstance(kind, WHOLE) or isinstance(kind, T.DecimalType) and kind.scale == 0


class Resolver:
    """Resolves expressions over one frame. A column that the frame lacks resolves to None."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.types = {f.name: f.dataType for f in df.schema.fields}

    def data_type(self, e: Expr) -> T.DataType | None:
        if isinstance(e, Alias):
            return self.data_type(e.inner)
        if isinstance(e, Col) and e.column in self.types:
            return self.types[e.column]
        column = self.scalar(e)
        return None if column is None else self.df.select(column).schema[0].dataType

    def column(self, name: str) -> Column | None:
        """A column of this name, or else a field of a struct column."""
        if name in self.types:
            return quoted(name)
        top, _, rest = name.partition(".")
        kind, out = self.types.get(top), quoted(top)
        for part in rest.split("."):
            if not isinstance(kind, T.StructType) or part not in kind.names:
                return None
            kind, out = kind[part].dataType, out.getField(part)
        return out

    def scalar(self, e: Expr) -> Column | None:
        """One column, not named yet."""
        match e:
            case Col(name):
                return self.column(name)
            case Lit(value):
                return F.lit(value)
            case Alias(inner, _):
                return self.scalar(inner)
            case Agg():
                return quoted(e.name) if e.name in self.types else None
            case Convert(inner, to):
                if to not in ("float64", "double", "float"):
                    raise PlanValidationError("Projection", [f"convert to {to} is not supported"])
                return _map(self.scalar(inner), lambda c: c.cast("double"))
            case IsNull(inner):
                return _map(self.scalar(inner), F.isnull)
            case Duration(seconds, per_second, column):
                return floor_bucket(quoted(column), seconds * per_second) if column in self.types else None
            case If(condition, then, otherwise):
                a, b = self.scalar(then), self.scalar(otherwise)
                return None if a is None or b is None else F.when(self.predicate(condition), a).otherwise(b)
            case Binary(op, left, right) if op in ARITHMETIC:
                a, b = self.scalar(left), self.scalar(right)
                if a is None or b is None:
                    return None
                if op == "/":
                    return divide(a, b, is_whole(self.data_type(left)) and is_whole(self.data_type(right)))
                return {"+": a + b, "-": a - b, "*": a * b}[op]
            case Binary(op) if op in PREDICATES:
                return F.coalesce(self.predicate(e), F.lit(False))
            case Not(inner):
                return F.coalesce(~self.predicate(inner), F.lit(False))
        raise PlanValidationError("Projection", [f"{e} can't be evaluated as one column"])

    def predicate(self, e: Expr) -> Column:
        """A condition for a filter, which Spark may push to the scan: null counts as false only at the end."""
        match e:
            case Binary("&&", left, right):
                return self.predicate(left) & self.predicate(right)
            case Binary("||", left, right):
                return self.predicate(left) | self.predicate(right)
            case Binary(op, left, right) if op in PREDICATES:
                column, value = self.scalar(left), right.value if isinstance(right, Lit) else None
                if column is None:
                    return F.lit(self.missing(op, value)) if op not in ("=~", "!~") else self._match(op, F.lit(""), value)
                if op in ("=~", "!~"):
                    return self._match(op, column, value)
                if op in ("contains", "not contains"):
                    return column.contains(value) if op == "contains" else ~column.contains(value)
                if isinstance(right, Lit) and value is None:
                    return {"==": column.isNull(), "!=": column.isNotNull()}.get(op, F.lit(False))
                if isinstance(value, date):  # of the column's own type, so that Spark pushes the test to the scan
                    return _COMPARE[op](column, F.lit(value.isoformat()).cast(self.data_type(left)))
                other = self.scalar(right)
                return F.lit(False) if other is None else _COMPARE[op](column, other)
            case Not(inner):
                return ~self.predicate(inner)
            case IsNull(inner):
                column = self.scalar(inner)
                return F.lit(True) if column is None else column.isNull()
        column = self.scalar(e)
        return F.lit(False) if column is None else column

    @staticmethod
    def _match(op: str, column: Column, pattern: str) -> Column:
        return column.rlike(pattern) if op == "=~" else ~column.rlike(pattern)

    @staticmethod
    def missing(op: str, value: object) -> bool:
        """A comparison with a column that the table lacks: it is null and an empty text at once."""
        if op == "==":
            return value is None or value == ""
        if op == "!=":
            return value is not None
        return value == "" if op == "contains" else op == "not contains" and value != ""

    def columns(self, e: Expr) -> list[Column]:
        """Named columns for a projection: none where a column is missing, several for a family."""
        match e:
            case All():
                return [quoted(c) for c in self.df.columns]
            case DynCol(family):
                return [quoted(c) for c in family_columns(self.df, family)]
            case Not(inner) if not any(isinstance(x, Binary) for x in inner.walk()):
                gone = set(self.matched(inner))
                return [quoted(c) for c in self.df.columns if c not in gone]
            case Duration(column=column):
                return [c.alias(column) for c in [self.scalar(e)] if c is not None]
        column = self.scalar(e)
        return [] if column is None else [column.alias(e.name)]

    def matched(self, e: Expr) -> list[str]:
        match e:
            case All():
                return list(self.df.columns)
            case DynCol(family):
                return family_columns(self.df, family)
        return [x.column for x in e.walk() if isinstance(x, Col)]


def _map(column: Column | None, f) -> Column | None:
    return None if column is None else f(column)


__all__ = ["COMPARISONS", "LOGIC", "Resolver", "family_columns", "is_whole", "quoted"]
