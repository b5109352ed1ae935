"""The query builder: an immutable list of nodes over a scan. A prefix may be shared by many queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from tessera import operators as ops

from .errors import PlanValidationError
from .exprs import Agg, Alias, Expr


@dataclass(frozen=True)
class Node:
    """kind: filter, project, distinct, aggregate, limit or sample."""

    kind: str
    exprs: tuple[Expr, ...] = ()
    groups: tuple[Expr, ...] = ()
    size: int = 0
    seed: int | None = None
    byte_limit: int | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        match self.kind:
            case "filter":
                return ops.filter_rows(df, self.exprs[0])
            case "project":
                return ops.project(df, self.exprs)
            case "distinct":
                return ops.distinct(df, self.exprs)
            case "aggregate":
                return ops.aggregate(df, self.exprs, self.groups)  # type: ignore[arg-type]
            case "limit":
                return ops.limit(df, self.size)
            case "sample":
                return ops.sample(df, self.size, self.seed, self.byte_limit)
        raise PlanValidationError(self.kind, ["no such node"])

    def stages(self) -> list[str]:
        """How it runs on many tasks: in each of them, then after an exchange."""
        listed = ",".join(map(str, self.exprs))
        match self.kind:
            case "filter":
                return [f"PredicateFilter ({self.exprs[0]})"]
            case "project":
                return [f"Projection ({', '.join(map(str, self.exprs))})"]
            case "distinct":
                own = f"Distinct ({', '.join(map(str, self.exprs))})"
                return [f"Projection ({', '.join(map(str, self.exprs))})", own, "Exchange", own]
            case "aggregate":
                own = f"HashAggregate ({listed} by {','.join(map(str, self.groups))})"
                return [own, "Exchange", own]
            case "limit":
                return [f"Limit({self.size})", "Exchange", f"Limit({self.size})"]
        return [f"Sample({self.size})", "Exchange", f"Sample({self.size})"]


@dataclass(frozen=True)
class Query:
    """Nothing runs before an action on frame()."""

    scan: Callable[[], DataFrame]
    source: str = "table"
    is_schema: bool = False
    nodes: tuple[Node, ...] = ()

    @classmethod
    def on(cls, df: DataFrame, name: str = "table") -> Query:
        return cls(lambda: df, name)

    def _then(self, node: Node) -> Query:
        return replace(self, nodes=(*self.nodes, node))

    def filter(self, condition: Expr | None) -> Query:
        return self if condition is None else self._then(Node("filter", (condition,)))

    def project(self, *exprs: Expr) -> Query:
        return self._then(Node("project", exprs))

    def distinct(self, *exprs: Expr) -> Query:
        return self._then(Node("distinct", exprs))

    def aggregate(self, aggs: Sequence[Agg | Alias], groups: Sequence[Expr] = ()) -> Query:
        return self._then(Node("aggregate", tuple(aggs), tuple(groups)))

    def limit(self, n: int) -> Query:
        return self._then(Node("limit", size=n))

    def sample(self, size: int, byte_limit: int | None = None, seed: int | None = None) -> Query:
        """byte_limit bounds what a task may hold and never changes the rows; any limit makes the sample hold none."""
        return self._then(Node("sample", size=size, seed=seed, byte_limit=byte_limit))

    def frame(self) -> DataFrame:
        """Validates the plan and makes Spark's."""
        df = self.scan()
        if self.is_schema:
            df = ops.schema_rows(df)
        for node in self.nodes:
            df = node.apply(df)
        return df

    def explain(self, physical: bool = False) -> str:
        """The query's own stages; with physical, also the plan that Spark makes of them."""
        out = ["SchemaScan" if self.is_schema else "TableScan"]
        for node in self.nodes:
            out += node.stages()
        said = " - ".join(out)
        if physical:
            df = self.frame()
            said += "\n" + df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        return said
