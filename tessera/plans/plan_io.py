"""Plans as dicts of JSON values, and back: {"scan": {"table": name} or {"schema": name}, "nodes": [...]}."""

from __future__ import annotations

import base64
from collections.abc import Callable
from datetime import date, datetime
from typing import Any

from .errors import NotSupportedError
from .exprs import Agg, Alias, All, Binary, Col, Convert, Duration, DynCol, Expr, If, IsNull, Lit, Not
from .query import Node, Query


def expr_to_dict(e: Expr) -> dict[str, Any]:
    match e:
        case Col(name):
            return {"col": name}
        case DynCol(family):
            return {"dyn": family}
        case All():
            return {"all": True}
        case Lit(bytes() as value):
            return {"bytes": base64.b64encode(value).decode()}
        case Lit(date() as value):
            return {"time": datetime.combine(value, datetime.min.time()).isoformat() if not isinstance(value, datetime) else value.isoformat()}
        case Lit(value):
            return {"lit": value}
        case Binary(op, left, right):
            return {"op": op, "left": expr_to_dict(left), "right": expr_to_dict(right)}
        case Not(inner):
            return {"not": expr_to_dict(inner)}
        case Convert(inner, to):
            return {"convert": expr_to_dict(inner), "to": to}
        case IsNull(inner):
            return {"isnull": expr_to_dict(inner)}
        case If(condition, then, otherwise):
            return {"if": [expr_to_dict(x) for x in (condition, then, otherwise)]}
        case Alias(inner, to):
            return {"alias": to, "of": expr_to_dict(inner)}
        case Duration(seconds, per_second, column):
            return {"second": seconds, "per_second": per_second, "column": column}
        case Agg(func, inner):
            return {"agg": func, "of": expr_to_dict(inner)}
    raise NotSupportedError(f"no form for {e}")


def expr_from_dict(d: dict[str, Any]) -> Expr:
    match d:
        case {"col": name}:
            return Col(name)
        case {"dyn": family}:
            return DynCol(family)
        case {"all": True}:
            return All()
        case {"bytes": text}:
            return Lit(base64.b64decode(text))
        case {"time": text}:
            return Lit(datetime.fromisoformat(text))
        case {"lit": value}:
            return Lit(value)
        case {"op": op, "left": left, "right": right}:
            return Binary(op, expr_from_dict(left), expr_from_dict(right))
        case {"not": inner}:
            return Not(expr_from_dict(inner))
        case {"convert": inner, "to": to}:
            return Convert(expr_from_dict(inner), to)
        case {"isnull": inner}:
            return IsNull(expr_from_dict(inner))
        case {"if": [condition, then, otherwise]}:
            return If(*map(expr_from_dict, (condition, then, otherwise)))
        case {"alias": to, "of": inner}:
            return Alias(expr_from_dict(inner), to)
        case {"second": seconds, **rest}:
            return Duration(seconds, rest.get("per_second", 1000), rest.get("column", "timestamp"))
        case {"agg": func, "of": inner}:
            return Agg(func, expr_from_dict(inner))
    raise NotSupportedError(f"no expression has the form {d}")


def to_plan(query: Query) -> dict[str, Any]:
    nodes: list[dict[str, Any]] = []
    for n in query.nodes:
        listed = [expr_to_dict(e) for e in n.exprs]
        match n.kind:
            case "filter":
                nodes.append({"filter": listed[0]})
            case "aggregate":
                nodes.append({"aggregate": {"aggs": listed, "groups": [expr_to_dict(e) for e in n.groups]}})
            case "limit":
                nodes.append({"limit": n.size})
            case "sample":
                nodes.append({"sample": {"size": n.size, "byte_limit": n.byte_limit, "seed": n.seed}})
            case kind:
                nodes.append({kind: listed})
    return {"scan": {"schema" if query.is_schema else "table": query.source}, "nodes": nodes}


def from_plan(plan: dict[str, Any], scan_table: Callable[[str], Query], scan_schema: Callable[[str], Query]) -> Query:
    match plan["scan"]:
        case {"table": name}:
            query = scan_table(name)
        case {"schema": name}:
            query = scan_schema(name)
        case other:
            raise NotSupportedError(f"no scan has the form {other}")
    for d in plan.get("nodes", []):
        match d:
            case {"filter": e}:
                query = query.filter(expr_from_dict(e))
            case {"project": listed}:
                query = query.project(*map(expr_from_dict, listed))
            case {"distinct": listed}:
                query = query.distinct(*map(expr_from_dict, listed))
            case {"aggregate": {"aggs": aggs, "groups": groups}}:
                query = query._then(Node("aggregate", tuple(map(expr_from_dict, aggs)), tuple(map(expr_from_dict, groups))))
            case {"limit": n}:
                query = query.limit(n)
            case {"sample": {"size": size, **rest}}:
                query = query.sample(size, rest.get("byte_limit"), rest.get("seed"))
            case other:
                raise NotSupportedError(f"no node has the form {other}")
    return query
