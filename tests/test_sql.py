from __future__ import annotations

import duckdb
import pytest
from deliveries import CASES, NAMES, ROWS
from pyspark.sql import functions as F

from tessera import queries
from tessera.engine import Engine
from tessera.plans.errors import NotSupportedError, PlanValidationError


def table(spark):
    kinds = ("string",) * 4 + ("long", "long", "double")
    return spark.createDataFrame([tuple(r) for r in ROWS], ", ".join(f"`{n}` {k}" for n, k in zip(NAMES, kinds, strict=True)))


def in_order(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("query", CASES)
def test_query_text(spark, query):
    assert in_order(Engine(spark, {"t": table(spark)}).sql("t", query).frame().collect()) == in_order(CASES[query])


def test_buckets_of_seconds(spark):
    df = table(spark).withColumnRenamed("minute", "timestamp")
    got = Engine(spark, {"t": df}).sql("t", "select second(60) as t, count(parcels) as n where parcels > 900 group by second(60)").frame()
    assert got.collect() == [] and got.columns[-1] == "n"


def test_limit_is_global(spark):
    df = table(spark).repartition(4)
    assert Engine(spark, {"t": df}).sql("t", "select parcels limit 2").frame().count() == 2


def test_explain(spark):
    said = Engine(spark, {"t": table(spark)}).sql("t", "explain select sum(parcels) as s where van = 'x' group by tags")
    assert said == "TableScan - PredicateFilter (van == x) - HashAggregate (sum(parcels) by tags) - Exchange - HashAggregate (sum(parcels) by tags) - Projection (sum(parcels) as s)"


@pytest.mark.parametrize("query", ["select parcels order by parcels", "select parcels from t", "select parcels having parcels > 1", "select parcels where parcels in (1)", "select parcels where parcels between 1 and 2", "select parcels where parcels is null", "select stddev(parcels) group by parcels", "select parcels limit 1 offset 2", "select convert(parcels, char)", "select case when parcels > 1 then 1 end", "select parcels where ;;", "select second(parcels)"])
def test_refused(spark, query):
    with pytest.raises(NotSupportedError):
        Engine(spark, {"t": table(spark)}).sql("t", query)


@pytest.mark.parametrize("query", ["select parcels where van = 1", "select parcels where parcels = 'x'", "select parcels where 1 = 1", "select parcels where parcels regexp 'x'", "select sum(van) group by parcels", "select sum(missing) group by parcels"])
def test_invalid(spark, query):
    with pytest.raises(PlanValidationError):
        Engine(spark, {"t": table(spark)}).sql("t", query).frame()


def test_both_sides_of_and_are_told(spark):
    with pytest.raises(PlanValidationError) as e:
        Engine(spark, {"t": table(spark)}).sql("t", "select parcels where van = 1 and parcels = 'x'").frame()
    assert len(e.value.problems) == 2


def test_null_tests_keep_every_row(spark, tmp_path):
    """More rows than the query's text once had as its limit."""
    rows = spark.range(1_000_003).select(F.col("id").alias("o_orderkey"), F.when(F.col("id") > 1, "F").alias("o_orderstatus"))
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    assert queries.QUERIES["sql_null"](spark, str(tmp_path)).count() == 1_000_001


def test_seconds_of_the_ends_of_hours(spark, tmp_path):
    """SQL's milliseconds are rounded: the last half of one belongs to the next hour."""
    db = duckdb.connect()
    away = (0, 1, 499, 500, 501, 1499, 1500, 999_999)
    times = [f"TIMESTAMP '2024-01-01 01:00:00' + INTERVAL ({n}) MICROSECOND" for k in away for n in (k, -k)]
    db.execute(f"CREATE TABLE events AS SELECT row_number() OVER () AS event_id, 'click' AS event_type, ts FROM (SELECT unnest([{', '.join(times)}, NULL]) AS ts)")
    db.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    got = queries.QUERIES["sql_second"](spark, str(tmp_path)).select("event_type", "n", "timestamp").collect()
    assert in_order(got) == in_order(db.sql(queries.ORACLE["sql_second"]).fetchall()) and len(got) == 3


def test_milliseconds(spark):
    micros = (-2500, -2499, -1501, -500, -499, 0, 499, 500, 1499, 1500, None)
    df = spark.createDataFrame([(m,) for m in micros], "m long").select(queries.millis(F.timestamp_micros("m").cast("timestamp_ntz")).alias("ms"))
    assert [r.ms for r in df.collect()] == [-3, -2, -2, -1, 0, 0, 0, 1, 1, 2, None]
