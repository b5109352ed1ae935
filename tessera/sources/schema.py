"""Table schemas: fixed columns, dynamic families whose keys become columns `family.key`, and sort keys."""

from __future__ import annotations

import dataclasses
import typing
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.resolve import family_columns, quoted

#: uint64 needs 20 digits; Spark has no unsigned type.
TYPES: dict[str, T.DataType] = {
    "string": T.StringType(), "binary": T.BinaryType(), "int64": T.LongType(), "int32": T.IntegerType(), "double": T.DoubleType(), "bool": T.BooleanType(), "uint64": T.DecimalType(20, 0),
}
HASHED = "hashed."


def type_of(name: str) -> T.DataType:
    """A declared type: one of TYPES, a list<> of one, or any nested type in Spark's own words."""
    if name.startswith("list<"):
        return T.ArrayType(type_of(name[5:-1]))
    return TYPES[name] if name in TYPES else T.DataType.fromDDL(name)


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str = "string"
    nullable: bool = False
    dynamic: bool = False
    pre_hash: bool = False


@dataclass(frozen=True)
class SortKey:
    name: str
    ascending: bool = True
    nulls_first: bool = False

    def order(self, column: str) -> Column:
        c = quoted(column)
        if self.ascending:
            return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()
        return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()


@dataclass(frozen=True)
class TableSchema:
    name: str
    columns: tuple[ColumnDef, ...]
    sort_keys: tuple[SortKey, ...] = ()
    unique: bool = False
    compression: str = "snappy"

    def definition(self, column: str) -> ColumnDef | None:
        """Of a concrete column: at most one dot is looked at."""
        for c in self.columns:
            if c.name == column or c.dynamic and column.startswith(c.name + "."):
                return c
        return None

    def expanded_keys(self, columns: list[str]) -> list[tuple[SortKey, str]]:
        """Sort keys over concrete columns: a family's in the order of its keys."""
        out = []
        for key in self.sort_keys:
            c = self.definition(key.name)
            found = sorted(x for x in columns if x.startswith(key.name + ".")) if c and c.dynamic else [key.name] if key.name in columns else []
            out += [(key, x) for x in found]
        return out

    def conform(self, df: DataFrame) -> DataFrame:
        """df with declared types, missing fixed columns as nulls, columns in lexical order, and hashes of pre-hashed ones."""
        unknown = [c for c in df.columns if self.definition(c) is None]
        if unknown:
            raise ValueError(f"{self.name} declares no {', '.join(unknown)}")
        out = {c: quoted(c).cast(type_of(self.definition(c).type)) for c in df.columns}  # type: ignore[union-attr]
        for c in self.columns:
            if not c.dynamic and c.name not in out:
                out[c.name] = F.lit(None).cast(type_of(c.type))
        for name in list(out):
            if self.definition(name).pre_hash:  # type: ignore[union-attr]
                out[HASHED + name] = F.xxhash64(out[name])
        return df.select(*(out[name].alias(name) for name in sorted(out)))

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> TableSchema:
        return cls(d["name"], tuple(ColumnDef(**c) for c in d["columns"]), tuple(SortKey(**k) for k in d["sort_keys"]), d["unique"], d["compression"])

    @classmethod
    def from_frame(cls, name: str, df: DataFrame, families: tuple[str, ...] = (), sort_keys: tuple[SortKey, ...] = ()) -> TableSchema:
        """A schema for what a frame (a Parquet file, say) has; a family's columns share the type of its first."""
        names = {v.simpleString(): k for k, v in TYPES.items()}

        def spell(kind: T.DataType) -> str:
            if isinstance(kind, T.ArrayType):
                return f"list<{spell(kind.elementType)}>"
            return names.get(kind.simpleString(), kind.simpleString())

        out = []
        for family in families:
            found = family_columns(df, family)
            out.append(ColumnDef(family, spell(df.schema[found[0]].dataType) if found else "string", True, True))
        for f in df.schema.fields:
            if not any(f.name.startswith(x + ".") for x in families):
                out.append(ColumnDef(f.name, spell(f.dataType), f.nullable))
        return cls(name, tuple(out), sort_keys)

    @classmethod
    def from_dataclass(cls, kind: type, name: str | None = None, unique: bool = False) -> TableSchema:
        """Fields str, int, float, bool, bytes, UUID, lists of these, and dicts, which are families.

        Metadata of a field: asc=n or desc=n (its place among the sort keys), null_first, pre_hash, type.
        """
        spelled = {str: "string", int: "int64", float: "double", bool: "bool", bytes: "binary", uuid.UUID: "binary"}
        hints, columns, keys = typing.get_type_hints(kind), [], []
        for f in dataclasses.fields(kind):
            hint, meta = hints[f.name], f.metadata
            origin, args = typing.get_origin(hint), typing.get_args(hint)
            if origin is list and args[0] is uuid.UUID:
                own, dynamic = "binary", False
            elif origin is list:
                own, dynamic = f"list<{spelled[args[0]]}>", False
            elif origin is dict:
                own, dynamic = spelled[args[1]], True
            else:
                own, dynamic = spelled[hint if hint in spelled else args[0]], False
            columns.append(ColumnDef(f.name, meta.get("type", own), dynamic or origin is list or hint not in spelled, dynamic, bool(meta.get("pre_hash"))))
            for word in ("asc", "desc"):
                if word in meta:
                    keys.append((meta[word], SortKey(f.name, word == "asc", bool(meta.get("null_first")))))
        return cls(name or kind.__name__.lower(), tuple(columns), tuple(k for _, k in sorted(keys, key=lambda x: x[0])), unique)


def sortable(*, asc: int | None = None, desc: int | None = None, **meta: object) -> typing.Any:
    """A dataclass field with sort key metadata."""
    return field(metadata={k: v for k, v in {"asc": asc, "desc": desc, **meta}.items() if v is not None})
