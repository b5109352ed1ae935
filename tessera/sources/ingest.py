"""Rows with maps to wide frames."""

from __future__ import annotations

import dataclasses
import typing
import uuid
from collections.abc import Iterable, Iterator
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.resolve import quoted

from .schema import TableSchema, type_of

#: A family is part of a table's schema, so its keys are few; more are an error, and none is dropped.
MOST_KEYS = 10_000


def expand_maps(df: DataFrame, *families: str) -> DataFrame:
    """Each map column becomes one column `family.key` for each key that any row has, in lexical order."""
    out = [quoted(c) for c in df.columns if c not in families]
    for family in families:
        found = df.select(F.explode(F.map_keys(quoted(family))).alias("k")).distinct().limit(MOST_KEYS + 1).collect()
        if len(found) > MOST_KEYS:
            raise ValueError(f"{family} has more than {MOST_KEYS} keys")
        for key in sorted(r.k for r in found):
            out.append(F.try_element_at(quoted(family), F.lit(key)).alias(f"{family}.{key}"))
    return df.select(*out)


def _stored(value: object, kind: str) -> object:
    """UUIDs are their 16 bytes; a list of them is packed from last to first. uint64 is a decimal."""
    if isinstance(value, uuid.UUID):
        return value.bytes
    if isinstance(value, list) and kind == "binary":
        return b"".join(x.bytes for x in reversed(value))
    return Decimal(value) if kind == "uint64" and isinstance(value, int) else value


def rows_to_frame(spark: SparkSession, rows: Iterable, schema: TableSchema) -> DataFrame:
    """Dataclass instances to a frame with the schema's columns; dicts become columns of their family."""
    fields = [T.StructField(c.name, T.MapType(T.StringType(), type_of(c.type)) if c.dynamic else type_of(c.type)) for c in schema.columns]
    data = [tuple(_stored(getattr(r, c.name), c.type) for c in schema.columns) for r in rows]
    df = spark.createDataFrame(data, T.StructType(fields))
    return expand_maps(df, *(c.name for c in schema.columns if c.dynamic))


def unpacked_uuids(value: bytes) -> list[uuid.UUID]:
    """The reverse of how a list of UUIDs is packed."""
    return [uuid.UUID(bytes=value[k : k + 16]) for k in range(0, len(value), 16)][::-1]


def rows_from_frame(df: DataFrame, kind: type) -> Iterator:
    """Dataclass instances of a frame's rows, in the driver, which holds one partition at a time: for results, not for tables. A
    family's columns that aren't null are its dict."""
    hints = typing.get_type_hints(kind)
    families = {f.name for f in dataclasses.fields(kind) if typing.get_origin(hints[f.name]) is dict}
    for row in df.toLocalIterator():
        values = row.asDict()
        own = {}
        for f in dataclasses.fields(kind):
            if f.name in families:
                own[f.name] = {c[len(f.name) + 1 :]: v for c, v in values.items() if c.startswith(f.name + ".") and v is not None}
            elif f.name in values:
                value = values[f.name]
                uuids = typing.get_args(hints[f.name]) == (uuid.UUID,)
                own[f.name] = unpacked_uuids(bytes(value or b"")) if uuids else value
        yield kind(**own)
