"""Looking into Parquet files and tables: python -m tessera.tools col|dump|find|reencode|row|rowgroup|schema|snapshot|stats|wal PATH [...].

snapshot and wal take a table's folder of a store: its versions, and what each of them changed. Paths are any that Spark reads.
"""

from __future__ import annotations

import argparse
import io
import json

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import filter_rows
from tessera.plans.exprs import col
from tessera.plans.resolve import quoted
from tessera.sources.schema import TableSchema
from tessera.sources.store import Files, Table


class _Remote(io.RawIOBase):
    """A file of any of Hadoop's file systems, read where the footer and its length say, not as a whole."""

    def __init__(self, spark: SparkSession, path: str):
        files = Files(spark, path)
        self.length = files.fs.getFileStatus(files.path(path)).getLen()
        self.stream, self.at = files.fs.open(files.path(path)), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.length}[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def read(self, size: int = -1) -> bytes:
        size = self.length - self.at if size is None or size < 0 else min(size, self.length - self.at)
        self.stream.seek(self.at)
        out = bytes(self.stream.readNBytes(size))
        self.at += len(out)
        return out


def _file(path: str, spark: SparkSession | None) -> pq.ParquetFile:
    return pq.ParquetFile(path if spark is None else _Remote(spark, path))


def stats(path: str, spark: SparkSession | None = None) -> dict:
    """A file's rows, row groups and bytes by column; a local one without Spark."""
    meta = _file(path, spark).metadata
    columns: dict[str, int] = {}
    for g in range(meta.num_row_groups):
        for c in range(meta.num_columns):
            own = meta.row_group(g).column(c)
            columns[own.path_in_schema] = columns.get(own.path_in_schema, 0) + own.total_compressed_size
    return {"rows": meta.num_rows, "row_groups": meta.num_row_groups, "bytes": columns}


def row_groups(path: str, spark: SparkSession | None = None) -> list[dict]:
    """Of each row group of a file: rows, and each column's smallest and largest value and nulls."""
    meta, out = _file(path, spark).metadata, []
    for g in range(meta.num_row_groups):
        own = {}
        for c in range(meta.num_columns):
            column = meta.row_group(g).column(c)
            s = column.statistics
            own[column.path_in_schema] = {"min": s.min if s and s.has_min_max else None, "max": s.max if s and s.has_min_max else None, "nulls": s.null_count if s else None}
        out.append({"rows": meta.row_group(g).num_rows, "columns": own})
    return out


def row(spark: SparkSession, path: str, number: int) -> dict | None:
    """The row of this number, from 0, of one file."""
    found = spark.read.parquet(path).where(F.col("_metadata.row_index") == number).first()
    return found and found.asDict()


def snapshots(table: Table) -> list[dict]:
    """A table's versions: number, recent inserts, blocks and columns."""
    versions = map(table.version, table.versions())
    return [{"version": v.number, "recent": len(v.recent), "blocks": len(v.blocks), "columns": [f["name"] for f in v.columns["fields"]]} for v in versions]


def changes(table: Table) -> list[dict]:
    """What each version changed, as the log has it."""
    return [json.loads(table.files.read(f"{table.root}/_log/{n:020d}.json")) for n in table.versions()]


def find(spark: SparkSession, path: str, column: str, value: str) -> DataFrame:
    """Rows whose column has this value, written as text."""
    df = spark.read.parquet(path)
    return filter_rows(df.withColumn("found_as", quoted(column).cast("string")), col("found_as").eq(value)).drop("found_as")


def reencode(spark: SparkSession, source: str, to: str, compression: str = "zstd", row_group_bytes: int = 128 << 20) -> None:
    spark.read.parquet(source).write.option("compression", compression).option("parquet.block.size", row_group_bytes).parquet(to)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("what", choices=["col", "dump", "find", "reencode", "row", "rowgroup", "schema", "snapshot", "stats", "wal"])
    parser.add_argument("path")
    parser.add_argument("more", nargs="*")
    args = parser.parse_args()
    if args.what in ("stats", "rowgroup"):
        spark = SparkSession.builder.getOrCreate() if "://" in args.path else None
        print(json.dumps((stats if args.what == "stats" else row_groups)(args.path, spark), indent=1, default=str))
        return
    spark = SparkSession.builder.getOrCreate()
    match args.what:
        case "schema":
            spark.read.parquet(args.path).printSchema()
        case "dump":
            spark.read.parquet(args.path).show(int(args.more[0]) if args.more else 20, truncate=False)
        case "col":
            spark.read.parquet(args.path).select(quoted(args.more[0])).show(truncate=False)
        case "find":
            find(spark, args.path, *args.more[:2]).show(truncate=False)
        case "row":
            print(json.dumps(row(spark, args.path, int(args.more[0])), indent=1, default=str))
        case "snapshot" | "wal":
            schema = TableSchema.from_dict(json.loads(Files(spark, args.path).read(f"{args.path}/_schema.json")))
            print(json.dumps((snapshots if args.what == "snapshot" else changes)(Table(spark, args.path, schema)), indent=1))
        case "reencode":
            reencode(spark, args.path, args.more[0])


if __name__ == "__main__":
    main()
