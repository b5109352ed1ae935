from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.plans.query import Query
from tessera.plans.resolve import quoted
from tessera.sources.store import Table


def rollup(stream: DataFrame, time: str, width: str, late: str, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Aggregates by time windows and keys: bucket (a window's begin), the keys, the aggregates.

    Rows later than `late` behind the newest are dropped, as the state of windows that old is.
    """
    out = stream.withWatermark(time, late).groupBy(F.window(quoted(time), width), *map(quoted, keys)).agg(*aggs)
    return out.withColumn("bucket", F.col("window.start")).select("bucket", *(quoted(c) for c in out.columns if c != "window"))


def start_rollup(rows: DataFrame, place: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Writes what a rollup changes, one folder of `place` for each micro-batch; a batch that runs again replaces its own."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/batch={number}")

    writer = rows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def rolled_up(spark: SparkSession, place: str, keys: Sequence[str]) -> DataFrame:
    """The rollup as its last batches left it: of each bucket and keys the newest row."""
    rows = spark.read.parquet(place)
    others = [c for c in rows.columns if c not in ("bucket", "batch", *keys)]
    newest = F.max_by(F.struct(*map(quoted, others)), F.col("batch")).alias("newest")
    return rows.groupBy("bucket", *map(quoted, keys)).agg(newest).select("bucket", *map(quoted, keys), "newest.*")


def run_query(stream: DataFrame, query: Query) -> DataFrame:
    """A query's filters, projections and aggregates over a stream in place of its scan."""
    for node in query.nodes:
        if node.kind in ("limit", "sample"):
            raise ValueError(f"{node.kind} has no meaning over a stream")
        stream = node.apply(stream)
    return stream


def start_ingest(stream: DataFrame, table: Table, checkpoint: str) -> StreamingQuery:
    """Each micro-batch becomes one insert; call processAllAvailable() or awaitTermination() on the result."""

    def insert(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            table.insert(batch)

    return stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).start()
