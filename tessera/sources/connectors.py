"""Stores of blocks outside a table: what a source and a sink are, a folder of Parquet blocks, and Iceberg tables."""

from __future__ import annotations

import json
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import filter_rows
from tessera.plans.errors import NotSupportedError
from tessera.plans.exprs import Binary, Col, Expr, Lit
from tessera.plans.resolve import quoted

from .store import Files


class DataSource(Protocol):
    def prefixes(self, prefix: str) -> list[str]: ...

    def scan(self, prefix: str, condition: Expr | None = None, before: str | None = None) -> DataFrame: ...


class DataSink(Protocol):
    def upload(self, name: str, df: DataFrame) -> None: ...

    def delete(self, name: str) -> None: ...


class BlockFolder:
    """<root>/<database>/<table>/<block>/, blocks named so that later ones sort after earlier ones.

    upload() leaves a manifest beside a block: its columns, and the least and largest value of those that have an order. A
    scan reads manifests instead of Parquet footers: the columns are those of all blocks, and blocks whose ranges rule the
    condition out are not opened. Blocks that others have written have no manifest; their columns come from one footer, and
    they are always read. A scan leaves out empty blocks, and with `before` those that are not older than that block.
    Without blocks it has no rows and no columns.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.files = Files(spark, root)

    def prefixes(self, prefix: str) -> list[str]:
        return [n for n in self.files.names(f"{self.root}/{prefix}") if not n.startswith(("_", "."))]

    def blocks(self, prefix: str, before: str | None = None) -> list[str]:
        return [b for b in self.prefixes(prefix) if (before is None or b < before) and any(n.endswith(".parquet") for n in self.files.names(f"{self.root}/{prefix}/{b}"))]

    def _manifest(self, prefix: str, block: str) -> dict:
        place = f"{self.root}/{prefix}/_manifest/{block}.json"
        if self.files.exists(place):
            return json.loads(self.files.read(place))
        return {"schema": json.loads(self.spark.read.parquet(f"{self.root}/{prefix}/{block}").schema.json()), "ranges": {}}

    def scan(self, prefix: str, condition: Expr | None = None, before: str | None = None) -> DataFrame:
        fields: dict[str, dict] = {}
        found = []
        for block in self.blocks(prefix, before):
            manifest = self._manifest(prefix, block)
            fields |= {f["name"]: f for f in manifest["schema"]["fields"]}
            if condition is None or may_hold(condition, manifest["ranges"]):
                found.append(f"{self.root}/{prefix}/{block}")
        schema = T.StructType.fromJson({"type": "struct", "fields": [f | {"nullable": True} for f in fields.values()]})
        df = self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)
        return filter_rows(df, condition)

    def upload(self, name: str, df: DataFrame) -> None:
        df.write.parquet(f"{self.root}/{name}")
        prefix, _, block = name.rpartition("/")
        kept = self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")
        ordered = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.IntegralType, T.DoubleType, T.FloatType))]
        ends = kept.agg(F.count(F.lit(1)), *(f(quoted(c)) for c in ordered for f in (F.min, F.max))).first()
        assert ends is not None
        ranges = {c: [ends[1 + 2 * k], ends[2 + 2 * k]] for k, c in enumerate(ordered) if not any(isinstance(x, float) and x != x for x in ends[1 + 2 * k : 3 + 2 * k])}
        self.files.write(f"{self.root}/{prefix}/_manifest/{block}.json", json.dumps({"schema": json.loads(df.schema.json()), "ranges": ranges}))

    def delete(self, name: str) -> None:
        self.files.delete(f"{self.root}/{name}")
        prefix, _, block = name.rpartition("/")
        self.files.delete(f"{self.root}/{prefix}/_manifest/{block}.json")


def may_hold(e: Expr, ranges: dict[str, list]) -> bool:
    """False only if no row of a block with these least and largest values can meet the condition."""
    match e:
        case Binary("&&", left, right):
            return may_hold(left, ranges) and may_hold(right, ranges)
        case Binary("||", left, right):
            return may_hold(left, ranges) or may_hold(right, ranges)
        case Binary(op, Col(name), Lit(value)) if name in ranges and value is not None:
            low, high = ranges[name]
            if low is None:  # nulls only
                return op not in ("==", "<", "<=", ">", ">=")
            if isinstance(value, str) != isinstance(low, str):
                return True
            return {"==": low <= value <= high, "<": low < value, "<=": low <= value, ">": high > value, ">=": high >= value}.get(op, True)
    return True


class IcebergTable:
    """An Iceberg table through Spark's connector, where its jar is on the class path."""

    def __init__(self, spark: SparkSession, name: str):
        try:
            spark.sparkContext._jvm.java.lang.Class.forName("org.apache.iceberg.spark.SparkCatalog")
        except Exception as e:
            raise NotSupportedError("Iceberg's Spark connector is not on the class path") from e
        self.spark, self.name = spark, name

    def prefixes(self, prefix: str = "") -> list[str]:
        return [r.tableName for r in self.spark.sql(f"SHOW TABLES IN {self.name.rpartition('.')[0]}").collect()]

    def scan(self, prefix: str = "", condition: Expr | None = None, before: str | None = None) -> DataFrame:
        reader = self.spark.read.option("snapshot-id", before) if before else self.spark.read
        return filter_rows(reader.table(self.name), condition)

    def upload(self, name: str, df: DataFrame) -> None:
        df.writeTo(self.name).append()

    def delete(self, name: str) -> None:
        raise NotSupportedError("an Iceberg table's snapshots expire by maintain()")

    def maintain(self, older_than: str) -> None:
        catalog = self.name.split(".")[0]
        self.spark.sql(f"CALL {catalog}.system.expire_snapshots(table => '{self.name}', older_than => TIMESTAMP '{older_than}')")
        self.spark.sql(f"CALL {catalog}.system.remove_orphan_files(table => '{self.name}')")
