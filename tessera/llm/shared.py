"""What the operators share: tables in the cluster's shared folder, whole inputs, sizing and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_own_dir: dict[str, str] = {}
_places: set[str] = set()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Python workers of this machine find the package wherever the driver's Python found it
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a folder of this machine, which only a local master has in common."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return _own_dir.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="tessera-"))


def temporary(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; it goes when the driver's JVM ends."""
    place = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return place


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table of the shared folder and returns the table: lineage ends here, and a lost executor costs nothing."""
    place = temporary(df.sparkSession, name)
    df.write.parquet(place)
    table = df.sparkSession.read.schema(df.schema).parquet(place)
    table.stored_at = place  # type: ignore[attr-defined]
    _places.add(place)
    return table


def _delete(spark: SparkSession, place: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _places.discard(place)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stored() has made, of which nobody will read again."""
    for table in tables:
        _delete(table.sparkSession, table.stored_at)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() returns, stored; the tables that were stored on the way to it are deleted."""
    before = set(_places)
    out = stored(make(), name)
    for place in _places - before - {out.stored_at}:
        _delete(out.sparkSession, place)
    return out


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker gets at a time to 2 MB, or a row, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in ("67108864b", "67108864"):  # Spark's default
        spark.conf.set(key, str(2 << 20))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows, which are stored, joined with table(keys, ...), which has a row for each key at most and may have the number n of
    its rows, without a task for all rows of one key.

    Keys of more than 1 in 4 * partitions of all rows, so at most 4 * partitions keys, are joined by a broadcast; the rows
    of the others are dealt by key, and no task gets much more than the others.
    """
    spark = rows.sparkSession
    least = rows.count() // (4 * parts(spark)) + 1
    if "n" in table.columns:
        hot = table.where(F.col("n") >= least)
    else:
        hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("hot_rows")).where(F.col("hot_rows") >= least).drop("hot_rows")
        hot = hot.join(table.hint("shuffle_hash"), keys)
    hot = stored(hot, "hot-keys")
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table, keys)
    return cold.unionByName(rows.join(F.broadcast(hot), keys).select(*cold.columns))


def repeated(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Stored rows whose key others have too, with `first`, the least `order` of the key's rows; spread as in spread_join()."""
    every = rows.groupBy(*keys).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    every = stored(every, "repeated-keys")
    return spread_join(rows, every, keys).drop("n")


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of long numbers to labels(node, label), label being the smallest node that can be reached.

    Alternates large-star and small-star rounds (Kiveris et al., 2014). Each is an aggregate with map-side combining and
    a join that adaptive execution may split, so no group's neighbours ever meet in one row. Every round ends in a table.
    """
    now = stored(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    seen = None
    if now.isEmpty():
        return now.sparkSession.createDataFrame([], "node long, label long")
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small-star: what large-star has made has the larger node first
        large = large.distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.union(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).groupBy("node").agg(
        F.min("label").alias("label")
    )
