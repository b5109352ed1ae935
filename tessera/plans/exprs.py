"""Expressions as frozen dataclasses: equal by structure, hashable, freely shared between plans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from typing import Any

# How operators print in column names and plans.
COMPARISONS = ("==", "!=", "<", "<=", ">", ">=")
TEXT_TESTS = ("=~", "!~", "contains", "not contains")
LOGIC = ("&&", "||")
ARITHMETIC = ("+", "-", "*", "/")
AGGREGATES = ("sum", "min", "max", "count", "avg", "unique", "and")
PREDICATES = COMPARISONS + TEXT_TESTS + LOGIC


class Expr:
    """A node of an expression tree. `name` is the name of the column that it makes."""

    @property
    def name(self) -> str:
        raise NotImplementedError

    def children(self) -> tuple[Expr, ...]:
        return tuple(v for f in fields(self) if isinstance(v := getattr(self, f.name), Expr))  # type: ignore[arg-type]

    def walk(self) -> Iterator[Expr]:
        yield self
        for child in self.children():
            yield from child.walk()

    def __str__(self) -> str:
        return self.name

    def alias(self, name: str) -> Alias:
        return Alias(self, name)

    def _with(self, op: str, other: Any) -> Binary:
        return Binary(op, self, literal(other))

    def eq(self, other: Any) -> Binary:
        return self._with("==", other)

    def not_eq(self, other: Any) -> Binary:
        return self._with("!=", other)

    def lt(self, other: Any) -> Binary:
        return self._with("<", other)

    def lt_eq(self, other: Any) -> Binary:
        return self._with("<=", other)

    def gt(self, other: Any) -> Binary:
        return self._with(">", other)

    def gt_eq(self, other: Any) -> Binary:
        return self._with(">=", other)

    def regex(self, pattern: str) -> Binary:
        return self._with("=~", pattern)

    def not_regex(self, pattern: str) -> Binary:
        return self._with("!~", pattern)

    def contains(self, needle: str) -> Binary:
        return self._with("contains", needle)

    def not_contains(self, needle: str) -> Binary:
        return self._with("not contains", needle)


@dataclass(frozen=True)
class Col(Expr):
    """One column by its exact name; `family.key` is one key of a dynamic family."""

    column: str

    @property
    def name(self) -> str:
        return self.column


@dataclass(frozen=True)
class DynCol(Expr):
    """Every column of a dynamic family, in the order of their keys."""

    family: str

    @property
    def name(self) -> str:
        return self.family


@dataclass(frozen=True)
class All(Expr):
    """Every column; whatever else a projection lists."""

    @property
    def name(self) -> str:
        return "all"


@dataclass(frozen=True)
class Lit(Expr):
    value: Any

    @property
    def name(self) -> str:
        return "null" if self.value is None else str(self.value).lower() if isinstance(self.value, bool) else str(self.value)


@dataclass(frozen=True)
class Binary(Expr):
    """Parentheses don't show in the name."""

    op: str
    left: Expr
    right: Expr

    @property
    def name(self) -> str:
        return f"{self.left.name} {self.op} {self.right.name}"


@dataclass(frozen=True)
class Not(Expr):
    """In a projection: all columns but those that `inner` matches. In a filter: the rows of which a predicate is false."""

    inner: Expr

    @property
    def name(self) -> str:
        return f"not {self.inner.name}"


@dataclass(frozen=True)
class Convert(Expr):
    """To float64, from whole numbers."""

    inner: Expr
    to: str = "float64"

    @property
    def name(self) -> str:
        return f"convert({self.inner.name}, {self.to})"


@dataclass(frozen=True)
class IsNull(Expr):
    inner: Expr

    @property
    def name(self) -> str:
        return f"isnull({self.inner.name})"


@dataclass(frozen=True)
class If(Expr):
    """A condition that is unknown chooses the second branch."""

    condition: Expr
    then: Expr
    otherwise: Expr

    @property
    def name(self) -> str:
        return f"if({self.condition.name}) {{ {self.then.name} }} else {{ {self.otherwise.name}}}"


@dataclass(frozen=True)
class Alias(Expr):
    inner: Expr
    to: str

    @property
    def name(self) -> str:
        return self.to

    def __str__(self) -> str:
        return f"{self.inner} as {self.to}"


@dataclass(frozen=True)
class Duration(Expr):
    """Buckets of `column`, of `seconds` seconds each; per_second tells the column's unit."""

    seconds: int
    per_second: int = 1000
    column: str = "timestamp"

    @property
    def name(self) -> str:
        return f"second({self.seconds})"


@dataclass(frozen=True)
class Agg(Expr):
    func: str
    inner: Expr

    @property
    def name(self) -> str:
        return f"{self.func}({self.inner.name})"


def literal(value: Any) -> Expr:
    return value if isinstance(value, Expr) else Lit(value)


def col(name: str) -> Col:
    return Col(name)


def cols(*names: str) -> list[Col]:
    return [Col(name) for name in names]


def _fold(op: str, parts: tuple[Expr | None, ...]) -> Expr | None:
    """Nested to the right; None is left out."""
    out = None
    for part in reversed([p for p in parts if p is not None]):
        out = part if out is None else Binary(op, part, out)
    return out


def and_(*parts: Expr | None) -> Expr | None:
    return _fold("&&", parts)


def or_(*parts: Expr | None) -> Expr | None:
    return _fold("||", parts)


def add(left: Any, right: Any) -> Binary:
    return Binary("+", literal(left), literal(right))


def sub(left: Any, right: Any) -> Binary:
    return Binary("-", literal(left), literal(right))


def mul(left: Any, right: Any) -> Binary:
    return Binary("*", literal(left), literal(right))


def div(left: Any, right: Any) -> Binary:
    return Binary("/", literal(left), literal(right))


def sum_(e: Expr) -> Agg:
    return Agg("sum", e)


def min_(e: Expr) -> Agg:
    return Agg("min", e)


def max_(e: Expr) -> Agg:
    return Agg("max", e)


def count(e: Expr) -> Agg:
    return Agg("count", e)


def avg(e: Expr) -> Agg:
    return Agg("avg", e)


def unique(e: Expr) -> Agg:
    return Agg("unique", e)


def all_true(e: Expr) -> Agg:
    return Agg("and", e)
