"""Query text to the builder: [EXPLAIN] SELECT [DISTINCT] items [WHERE condition] [GROUP BY items] [LIMIT n].

The table is given with the text, so there is no FROM. A name with a dot is a key of a family; a family's own name is all
of its columns. LIKE tests for a part of the text and has no wildcards.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .errors import NotSupportedError
from .exprs import Agg, Alias, All, Binary, Col, Convert, Duration, DynCol, Expr, Lit
from .query import Query

_TOKEN = re.compile(r"\s*(?:(?P<number>\d+\.\d+|\d+)|(?P<text>'(?:[^']|'')*')|(?P<name>[A-Za-z_][\w]*(?:\.[\w]+)*|`[^`]+`)|(?P<sign><=|>=|!=|<>|[-+*/=<>(),]))")
_FUNCTIONS = ("count", "sum", "min", "max", "avg")
_REFUSED = {"order": "ORDER BY", "having": "HAVING", "offset": "OFFSET", "from": "FROM", "join": "JOIN", "union": "UNION", "in": "IN", "between": "BETWEEN", "is": "IS", "case": "CASE"}
_KEYWORDS = {"select", "distinct", "where", "group", "by", "limit", "as", "and", "or", "not", "like", "regexp", "explain", *_REFUSED}


@dataclass(frozen=True)
class Parsed:
    query: Query
    explain: bool


class _Parser:
    def __init__(self, text: str, df: DataFrame):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.strip().rstrip(";").rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise NotSupportedError(f"can't read {text[at : at + 20]!r}")
            kind = m.lastgroup or ""
            self.tokens.append((kind, m[kind]))
            at = m.end()
        self.at = 0
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.families = {c.split(".")[0] for c in df.columns if "." in c} - set(df.columns)

    def peek(self, word: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1].lower() == word

    def take(self, word: str) -> bool:
        if self.peek(word):
            self.at += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            found = self.tokens[self.at][1] if self.at < len(self.tokens) else "the end"
            raise NotSupportedError(f"{_REFUSED.get(found.lower(), found)} where {word.upper()} is due")

    def listed(self, item: Callable[[], Expr]) -> list[Expr]:
        out = [item()]
        while self.take(","):
            out.append(item())
        return out

    def row_or_list(self, item: Callable[[], Expr]) -> list[Expr]:
        """a, b or (a, b)."""
        start = self.at
        if self.take("("):
            out = self.listed(item)
            if len(out) > 1 and self.take(")"):
                return out
            self.at = start
        return self.listed(item)

    def item(self) -> Expr:
        e = self.condition()
        if self.take("as"):
            kind, name = self.tokens[self.at]
            if kind != "name":
                raise NotSupportedError(f"{name} is no name")
            self.at += 1
            return Alias(e, name.strip("`"))
        return e

    def condition(self) -> Expr:
        e = self.conjunction()
        while self.take("or"):
            e = Binary("||", e, self.conjunction())
        return e

    def conjunction(self) -> Expr:
        e = self.test()
        while self.take("and"):
            e = Binary("&&", e, self.test())
        return e

    def test(self) -> Expr:
        e = self.total()
        for sign, op in (("=", "=="), ("!=", "!="), ("<>", "!="), ("<=", "<="), (">=", ">="), ("<", "<"), (">", ">")):
            if self.take(sign):
                return Binary(op, e, self.boolean(e, self.total()))
        start = self.at
        negated = self.take("not")
        for word, ops in (("like", ("contains", "not contains")), ("regexp", ("=~", "!~"))):
            if self.take(word):
                return Binary(ops[negated], e, self.total())
        self.at = start
        return e

    def boolean(self, left: Expr, right: Expr) -> Expr:
        if isinstance(left, Col) and isinstance(self.types.get(left.column), T.BooleanType) and isinstance(right, Lit) and isinstance(right.value, str):
            return Lit(right.value.lower() == "true")
        return right

    def total(self) -> Expr:
        e = self.product()
        while self.peek("+") or self.peek("-"):
            op = self.tokens[self.at][1]
            self.at += 1
            e = Binary(op, e, self.product())
        return e

    def product(self) -> Expr:
        e = self.atom()
        while self.peek("*") or self.peek("/"):
            op = self.tokens[self.at][1]
            self.at += 1
            e = Binary(op, e, self.atom())
        return e

    def atom(self) -> Expr:
        if self.at >= len(self.tokens):
            raise NotSupportedError("the text ends where an expression is due")
        if self.take("("):
            e = self.condition()
            self.need(")")
            return e
        if self.take("*"):
            return All()
        if self.take("-"):
            e = self.atom()
            return Lit(-e.value) if isinstance(e, Lit) else Binary("-", Lit(0), e)
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Lit(float(text) if "." in text else int(text))
        if kind == "text":
            return Lit(text[1:-1].replace("''", "'"))
        word = text.lower()
        if kind != "name" or word in _KEYWORDS:
            raise NotSupportedError(f"{_REFUSED.get(word, text.upper())} is not supported here")
        if word in ("null", "true", "false"):
            return Lit({"null": None, "true": True, "false": False}[word])
        if self.take("("):
            return self.call(word)
        name = text.strip("`")
        return DynCol(name) if name in self.families else Col(name)

    def call(self, name: str) -> Expr:
        if name in ("convert", "cast"):
            inner = self.condition()
            self.need("," if name == "convert" else "as")
            to = self.tokens[self.at][1].lower()
            self.at += 1
            if to not in ("float", "double"):
                raise NotSupportedError(f"{name.upper()} to {to}")
            out: Expr = Convert(inner)
        elif name == "second":
            n = self.atom()
            if not isinstance(n, Lit) or not isinstance(n.value, int):
                raise NotSupportedError("SECOND of anything but a number")
            out = Duration(n.value)
        elif name in _FUNCTIONS:
            out = Agg(name, self.condition())
        else:
            raise NotSupportedError(f"function {name}")
        self.need(")")
        return out


def _has_aggregate(e: Expr) -> bool:
    return any(isinstance(x, Agg) for x in e.walk())


def _after(e: Expr, keys: dict[Expr, Expr]) -> Expr:
    """e over the aggregation's columns: its keys are columns there."""
    if e in keys:
        return keys[e]
    match e:
        case Alias(inner, to):
            return Alias(_after(inner, keys), to)
        case Agg():
            return Col(e.name)
        case Binary(op, left, right):
            return Binary(op, _after(left, keys), _after(right, keys))
        case Convert(inner, to):
            return Convert(_after(inner, keys), to)
    return e


def parse(text: str, scan: Callable[[], DataFrame], name: str = "table") -> Parsed:
    p = _Parser(text, scan())
    explain = p.take("explain")
    p.need("select")
    distinct = p.take("distinct")
    items = p.row_or_list(p.item)
    query = Query(scan, name)
    if p.take("where"):
        query = query.filter(p.condition())
    groups: list[Expr] = []
    grouped = p.take("group")
    if grouped:
        p.need("by")
        groups = p.row_or_list(p.condition)
    size = None
    if p.take("limit"):
        kind, value = p.tokens[p.at] if p.at < len(p.tokens) else ("", "nothing")
        if kind != "number" or not value.isdigit():
            raise NotSupportedError(f"LIMIT {value}")
        p.at += 1
        size = int(value)
    if p.at < len(p.tokens):
        word = p.tokens[p.at][1]
        raise NotSupportedError(f"{_REFUSED.get(word.lower(), word)} is not supported")

    if grouped or any(map(_has_aggregate, items)):
        aliases = {e.to: e for e in items if isinstance(e, Alias)}
        keys = [aliases.get(g.column, g) if isinstance(g, Col) else g for g in groups]
        after: dict[Expr, Expr] = {}
        for g in keys:
            own: Expr = g if isinstance(g, DynCol) else Col(g.column if isinstance(g, Duration) else g.name)
            after[g] = own
            if isinstance(g, Alias):
                after[g.inner] = own
        aggs = list(dict.fromkeys(x for e in items for x in e.walk() if isinstance(x, Agg)))
        query = query.aggregate(aggs, keys) if aggs else query.distinct(*keys)
        query = query.project(*(_after(e, after) for e in items))
        if distinct:
            query = query.distinct(*(Col(e.name) if not isinstance(e, DynCol) else e for e in items))
    else:
        query = query.distinct(*items) if distinct else query.project(*items)
    if size is not None:
        query = query.limit(size)
    return Parsed(query, explain)
