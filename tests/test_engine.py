from __future__ import annotations

import importlib
import importlib.util
import os
import random
import uuid
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.plans.errors import PlanValidationError
from tessera.plans.exprs import (
    Agg, All, Col, Convert, Duration, DynCol, If, IsNull, Lit, Not, add, all_true, and_, avg, col, cols, count, div, max_, min_, mul, or_, sub, sum_, unique,
)
from tessera.plans.plan_io import from_plan, to_plan
from tessera.plans.query import Query
from tessera.sources import ColumnDef, SortKey, Store, TableSchema, expand_maps
from tessera.sources.connectors import BlockFolder, IcebergTable
from tessera.sources.ingest import rows_from_frame, unpacked_uuids
from tessera.sources.schema import sortable


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def on(spark, data, schema):
    return Query.on(spark.createDataFrame(data, schema))


def test_unique(spark):
    q = on(spark, [(1, 1), (2, 1), (3, 3), (None, 4)], "example long, timestamp long")
    assert rows(q.aggregate([unique(col("example"))], [col("timestamp")]).frame()) == [(1, None), (3, 3), (4, None)]


def test_and(spark):
    q = on(spark, [(True, 1), (False, 1), (True, 3), (True, 3), (None, 5)], "example boolean, timestamp long")
    assert rows(q.aggregate([all_true(col("example"))], [col("timestamp")]).frame()) == [(1, False), (3, True), (5, True)]


def test_if_and_is_null(spark):
    q = on(spark, [(1, 1), (2, None), (3, 3)], "example long, timestamp long")
    assert rows(q.project(If(col("timestamp").eq(3), Lit(1), Lit(0)).alias("x"), IsNull(col("timestamp"))).frame()) == [(0, False), (0, True), (1, False)]
    assert q.project(If(col("a").gt(1), col("b"), col("c"))).frame().columns == []


def test_count_counts_nulls_and_sum_skips_them(spark):
    q = on(spark, [("a", 1), ("a", None), ("b", None)], "k string, v long")
    assert rows(q.aggregate([count(col("v")), sum_(col("v")), avg(col("v"))], [col("k")]).frame()) == [("a", 2, 1, 1), ("b", 1, None, None)]


def test_zero_and_null_are_different_groups(spark):
    q = on(spark, [(0, 1), (None, 2)], "k long, v long")
    assert rows(q.aggregate([sum_(col("v"))], [col("k")]).frame()) == [(0, 1), (None, 2)]


def test_filter_keeps_all_columns_and_evaluates_arithmetic(spark):
    q = on(spark, [(1, "x"), (3, "y")], "value long, s string")
    assert rows(q.filter(add(col("value"), Lit(1)).gt(3)).frame()) == [(3, "y")]
    assert rows(q.filter(Not(col("value").gt(2))).frame()) == [(1, "x")]


def test_families(spark):
    q = on(spark, [(1, 2, None), (3, None, 4)], "`foo.bar` long, `foo.baz` long, other long")
    assert q.aggregate([max_(DynCol("foo"))], []).frame().collect()[0].asDict() == {"max(foo.bar)": 3, "max(foo.baz)": 2}
    assert q.project(DynCol("foo")).frame().columns == ["foo.bar", "foo.baz"]
    assert q.project(Not(DynCol("foo"))).frame().columns == ["other"]
    assert q.project(All(), col("foo.bar")).frame().columns == ["foo.bar", "foo.baz", "other"]
    with pytest.raises(PlanValidationError):
        q.aggregate([max_(DynCol("none"))], []).frame()


def test_arrays_as_keys(spark):
    q = on(spark, [(["a"], 1), (["a"], 2), (None, 3), ([], 4)], "k array<string>, v long")
    assert len(rows(q.aggregate([sum_(col("v"))], [col("k")]).frame())) == 3


def test_duration_is_a_floor(spark):
    q = on(spark, [(-1, 1), (999, 2), (1000, 3)], "timestamp long, v long")
    assert rows(q.aggregate([sum_(col("v"))], [Duration(1)]).frame()) == [(-1000, 1), (0, 2), (1000, 3)]


def test_struct_fields(spark):
    q = on(spark, [((1, "x"), 2), ((5, None), 3)], "s struct<a:long,b:string>, v long")
    assert rows(q.filter(col("s.a").gt(2)).project(col("s.a"), col("s.b"), col("s.nobody")).frame()) == [(5, None)]
    assert rows(q.aggregate([sum_(col("v"))], [col("s.b")]).frame()) == [("x", 2), (None, 3)]


def test_division(spark):
    q = on(spark, [(-7, 2, 1.0, 0.0), (7, 0, 1.0, 4.0)], "a long, b long, x double, y double")
    assert rows(q.project(div(col("a"), col("b")), div(col("x"), col("y"))).frame()) == [(-3, None), (None, 0.25)]


def test_names(spark):
    e = div(sub(col("a"), col("b")), Lit(2))
    assert (e.name, sum_(col("v")).name, Convert(col("v")).name, IsNull(col("v")).name, Duration(5).name) == ("a - b / 2", "sum(v)", "convert(v, float64)", "isnull(v)", "second(5)")
    assert and_(None, None) is None and or_(col("a").eq(1), None) == col("a").eq(1)
    assert {col("a"): 1}[Col("a")] == 1


def test_aggregate_over_limit_and_having(spark):
    q = on(spark, [(k, k % 2) for k in range(10)], "v long, g long")
    assert q.limit(4).aggregate([count(col("v"))]).frame().first()[0] == 4
    assert rows(q.aggregate([sum_(col("v")).alias("s")], [col("g")]).filter(col("s").gt(20)).frame()) == [(1, 25)]


def test_prefixes_are_shared(spark):
    q = on(spark, [(k,) for k in range(5)], "v long").filter(col("v").gt(1))
    assert q.limit(1).frame().count() == 1 and q.frame().count() == 3


def test_plan_round_trip(spark):
    q = on(spark, [(1, "x", 2.0)], "v long, s string, f double")
    q = q.filter(or_(and_(col("v").gt(0), col("s").regex("x")), Not(col("s").contains("y")))).project(All())
    q = q.aggregate([avg(mul(col("v"), Lit(2))).alias("a"), Agg("min", col("f"))], [col("s"), Duration(3, 1000, "v")])
    q = q.project(col("s"), If(col("a").eq(1), col("a"), Lit(0)), IsNull(col("a")), Convert(col("a")), Lit(b"z").alias("z")).distinct(*cols("s")).sample(3, seed=1).limit(2)
    back = from_plan(to_plan(q), lambda name: Query(q.scan, name), lambda name: Query(q.scan, name, True))
    assert back.nodes == q.nodes and rows(back.frame()) == rows(q.frame())


def test_sample_is_uniform(spark):
    df = spark.range(100).coalesce(4).cache()
    seen = Counter(r.id for k in range(150) for r in Query.on(df).sample(10, seed=k).frame().collect())
    assert sum(seen.values()) == 1500 and len(seen) > 95 and max(seen.values()) < 40
    assert Query.on(df).sample(1000).frame().count() == 100
    with pytest.raises(PlanValidationError):
        Query.on(df).limit(-1).frame()


def test_a_samples_byte_limit_does_not_change_it(spark, tmp_path):
    spark.range(20_000).select("id", F.lit("x").alias("sample_id1")).repartition(5).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for size, seed in ((0, 1), (1, 2), (37, 3), (4000, 4)):
        kept, bounded = (Query.on(df).sample(size, limit, seed).frame() for limit in (None, 1 << 20))
        assert bounded.columns == df.columns and rows(kept) == rows(bounded) and bounded.count() == size
    assert Query.on(df).sample(10**6, 1).frame().count() == 20_000 and Query.on(df.limit(0)).sample(3, 1).frame().count() == 0
    assert "TakeOrdered" not in Query.on(df).sample(500, 1, 7).frame().where("id > 3")._jdf.queryExecution().executedPlan().toString().split("Union")[0]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") % 7).alias("v"), F.lit("x").alias("s")).write.parquet(str(tmp_path / "t"))
    q = Query(lambda: spark.read.parquet(str(tmp_path / "t"))).filter(and_(col("v").gt(3), col("s").eq("x"))).aggregate([sum_(col("id"))], [col("v")])
    plan = q.frame()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(v,3)" in plan and "EqualTo(s,x)" in plan and plan.count("HashAggregate") == 2


def test_times_reach_the_scan(spark, tmp_path):
    for kind in ("timestamp", "timestamp_ntz", "date"):
        place = str(tmp_path / kind)
        spark.range(10).select("id", F.expr(f"CAST(date_add(DATE '2024-01-01', CAST(id AS INT)) AS {kind})").alias("t")).write.parquet(place)
        q = Query(lambda p=place: spark.read.parquet(p)).filter(and_(col("t").gt_eq(datetime(2024, 1, 4)), col("t").lt(datetime(2024, 1, 6))))
        assert [r[0] for r in rows(q.frame())] == [3, 4]
        assert "GreaterThanOrEqual(t,2024-01-04" in q.frame()._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(PlanValidationError):
        q.filter(col("t").gt(5)).frame()
    with pytest.raises(PlanValidationError):
        q.filter(col("id").gt(datetime(2024, 1, 4))).frame()
    assert from_plan(to_plan(q), lambda name: q, lambda name: q).nodes[-1] == q.nodes[-1]


def test_the_flagship_prunes_by_its_date(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the driver's tables are not there")
    from tessera.queries import flagship

    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = flagship(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "LessThan(l_shipdate,1998-09-02" in plan and "GreaterThan(l_quantity,10.0)" in plan


def test_explain_has_sparks_plan_too(spark):
    q = on(spark, [(1, "x")], "v long, s string").filter(col("v").gt(0)).aggregate([sum_(col("v"))], [col("s")])
    assert q.explain() == "TableScan - PredicateFilter (v > 0) - HashAggregate (sum(v) by s) - Exchange - HashAggregate (sum(v) by s)"
    assert q.explain(physical=True).startswith(q.explain()) and "== Physical Plan ==" in q.explain(physical=True) and "hashpartitioning(s" in q.explain(physical=True)


def test_entry_without_the_llm_package(monkeypatch):
    """Missing third-party packages leave the core; errors of our own don't pass."""
    import __spark_entry__ as entry

    assert len(entry.queries()) > 90
    real = importlib.import_module

    def missing(name):
        def imported(module, *rest):
            if module == "tessera.llm.queries":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)
            return real(module, *rest)

        return imported

    monkeypatch.setattr(importlib, "import_module", missing("ahocorasick"))
    assert "flagship" in entry.queries() and "pipeline" not in entry.queries() and "flagship" in entry.oracle_sql()
    if importlib.util.find_spec("tessera.llm.queries" if importlib.util.find_spec("tessera.llm") else "none_such"):
        monkeypatch.setattr(importlib, "import_module", missing("tessera.llm.words"))
        with pytest.raises(ModuleNotFoundError):
            entry.queries()


# Store

PROFILES = TableSchema("profiles", (ColumnDef("labels", "string", True, True, pre_hash=True), ColumnDef("stack", "string"), ColumnDef("timestamp", "int64"), ColumnDef("value", "int64"), ColumnDef("big", "uint64", True)), (SortKey("labels", nulls_first=True), SortKey("timestamp", False)))


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    t = store.table("db", PROFILES)
    assert t.read().columns == ["big", "stack", "timestamp", "value"] and t.read().count() == 0
    first = t.insert(spark.createDataFrame([("a", "s", 1, 1)], "`labels.x` string, stack string, timestamp long, value long"))
    t.insert(spark.createDataFrame([("b", "s", 2, 2, Decimal(2**64 - 1))], "`labels.y` string, stack string, timestamp long, value long, big decimal(20,0)"))
    assert t.read().columns == ["big", "labels.x", "labels.y", "stack", "timestamp", "value"]
    assert rows(t.query().aggregate([sum_(col("value"))], [DynCol("labels")]).frame()) == [("a", None, 1), (None, "b", 2)]
    assert t.read(version=first).count() == 1 and "hashed.labels.x" in t.read(hashes=True).columns
    assert {r.name for r in t.scan_schema().collect()} >= {"labels.x", "labels.y", "hashed.labels.x", "stack"}
    t.rotate()
    assert t.read(mode="recent").count() == 0 and t.read(mode="blocks").count() == 2
    t.insert(spark.createDataFrame([("c", 3)], "`labels.x` string, value long"))
    t.compact()
    assert t.read().count() == 3 and len(t.version().blocks) == 1
    t.expire()
    assert len(t.versions()) == 1 and t.read().count() == 3
    assert store.tables("db") == ["profiles"] and store.table("db", "profiles").schema == PROFILES and store.databases() == ["db"]
    with pytest.raises(ValueError):
        t.insert(spark.createDataFrame([(1,)], "nobody long"))
    with pytest.raises(KeyError):
        store.table("db", "none")


NUMBERS = TableSchema("n", (ColumnDef("v", "int64"),), (SortKey("v"),))


def numbers(spark, tmp_path, inserts=2):
    t = Store(spark, f"file://{tmp_path}").table("db", NUMBERS)
    for k in range(inserts):
        t.insert(spark.createDataFrame([(k,)], "v long"))
    return t


@pytest.mark.parametrize("first,second", [("rotate", "compact"), ("compact", "rotate"), ("rotate", "rotate"), ("compact", "compact")])
def test_maintenance_by_two_writers_keeps_each_row_once(spark, tmp_path, first, second):
    """The second writer comes between the first one's write and its commit."""
    one = numbers(spark, tmp_path, 5)
    two = Store(spark, f"file://{tmp_path}").table("db", "n")
    commit = one._commit

    def late(change):
        one._commit = commit
        two.insert(spark.createDataFrame([(99,)], "v long"))
        getattr(two, second)()
        return commit(change)

    one._commit = late
    getattr(one, first)()
    assert sorted(r.v for r in one.read().collect()) == [0, 1, 2, 3, 4, 99] == sorted(r.v for r in two.read().collect())
    one.expire()
    assert one.read().count() == 6


def test_metrics(spark, tmp_path):
    t = numbers(spark, tmp_path, 3)
    t.rotate()
    t.insert(spark.range(5).select(F.col("id").alias("v")))
    t.compact()
    t.read()
    seen = t.metrics.snapshot()
    assert (seen["inserts_total"], seen["recent_rows"], seen["blocks_rows"], seen["rotations_total"], seen["compactions_total"], seen["commits_total"], seen["scans_total"]) == (4, 8, 11, 1, 1, 6, 1)
    assert seen["inserts_seconds"] > 0 and 'tessera_inserts_total{table="n"} 4' in t.metrics.text(table="n")


def test_many_writers_at_once(spark, tmp_path):
    numbers(spark, tmp_path, 0)
    root = f"file://{tmp_path}"

    def write(k):
        t = Store(spark, root).table("db", "n")
        t.insert(spark.createDataFrame([(k,)], "v long"))
        if k % 4 == 0:
            t.rotate()
        if k % 6 == 0:
            t.compact()

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(write, range(12)))
    t = Store(spark, root).table("db", "n")
    assert sorted(r.v for r in t.read().collect()) == list(range(12))


def test_only_one_of_many_creates_a_file(spark, tmp_path):
    from tessera.sources.store import Files

    files = Files(spark, f"file://{tmp_path}")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: files.create(f"file://{tmp_path}/x.json", str(k)), range(24)))
    assert sum(won) == 1 and files.read(f"file://{tmp_path}/x.json") == str(won.index(True))
    assert files.names(f"file://{tmp_path}") == ["x.json"]


def test_the_log_is_read_from_its_last_whole_state(spark, tmp_path):
    from tessera.sources import store

    t = numbers(spark, tmp_path, 0)
    for k in range(2 * store.CHECKPOINT + 3):  # commits only
        t._commit(store.Change(recent={f"recent/{k}": ["v"]}))
    read = []
    real = t.files.read
    t.files.read = lambda name: read.append(name) or real(name)
    assert list(t.version().recent) == [f"recent/{k}" for k in range(2 * store.CHECKPOINT + 3)] and len(read) == 5
    t.files.read = real
    for n in (0, 1, 19, 20, 21, 43):
        assert t.version(n).number == n and len(t.version(n).recent) == n
    (tmp_path / "db/n/_log/_last").write_text("")  # while another writer renews it
    assert t.version().number == 43


def test_unique_rows_go_at_compaction(spark, tmp_path):
    t = Store(spark, f"file://{tmp_path}").table("db", TableSchema("names", (ColumnDef("name"),), (SortKey("name"),), unique=True))
    for _ in range(3):
        t.insert(spark.createDataFrame([("x",)] * 3, "name string"))
    assert t.read().count() == 9
    t.compact()
    assert t.read().count() == 1


def test_layout_is_sorted(spark, tmp_path):
    t = Store(spark, f"file://{tmp_path}").table("db", TableSchema("n", (ColumnDef("a", "string", True), ColumnDef("b", "int64")), (SortKey("a", nulls_first=True), SortKey("b", False))))
    t.insert(spark.createDataFrame([("x", 1), (None, 2), ("x", 5), ("a", 0)], "a string, b long").coalesce(1))
    assert [tuple(r) for r in t.read().collect()] == [(None, 2), ("a", 0), ("x", 5), ("x", 1)]


def test_compacted_files_have_ranges_of_their_own(spark, tmp_path):
    from tessera import tools

    t = Store(spark, f"file://{tmp_path}").table("db", NUMBERS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for k in range(3):
            t.insert(spark.range(k, 3000, 3).select(F.col("id").alias("v")).repartition(2))
        t.compact()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (block,) = t.version().blocks
    ranges = []
    for file in (tmp_path / "db/n" / block).glob("*.parquet"):
        for group in tools.row_groups(str(file)):
            ranges.append((group["columns"]["v"]["min"], group["columns"]["v"]["max"]))
    ranges.sort()
    assert len(ranges) > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False)) and ranges[0][0] == 0 and ranges[-1][1] == 2999


def test_random_order_of_inserts_and_compactions_loses_nothing(spark, tmp_path):
    rng = random.Random(5)
    t = Store(spark, f"file://{tmp_path}").table("db", TableSchema("m", (ColumnDef("v", "int64"), ColumnDef("l", "int64", True, True)), (SortKey("v"),)))
    expected: Counter = Counter()
    for k in range(10):
        match rng.choice(["insert", "insert", "rotate", "compact", "expire"]):
            case "insert":
                t.insert(spark.createDataFrame([(k, k)], f"v long, `l.k{k % 3}` long"))
                expected[k] += 1
            case other:
                getattr(t, other)()
    assert Counter(r.v for r in t.read().select("v").collect()) == expected


@dataclass
class Sample:
    example_type: str = sortable(asc=0)
    labels: dict[str, str] = sortable(asc=1, null_first=True)
    stacktrace: list[uuid.UUID] = sortable()
    timestamp: int = sortable(desc=2)
    values: list[int] = field(default_factory=list)
    weight: float = 0.0


def test_dataclasses(spark, tmp_path):
    schema = TableSchema.from_dataclass(Sample)
    assert [k.name for k in schema.sort_keys] == ["example_type", "labels", "timestamp"] and not schema.sort_keys[2].ascending
    assert schema.definition("labels.a").dynamic and schema.definition("values").type == "list<int64>"
    t = Store(spark, f"file://{tmp_path}").table("db", schema)
    ids = [uuid.uuid4(), uuid.uuid4()]
    t.insert_rows([Sample("a", {"x": "1"}, ids, 5, [1, 2]), Sample("b", {"y": "2"}, [], 6, [])])
    out = {r.example_type: r for r in t.read().collect()}
    assert out["a"]["labels.x"] == "1" and out["a"]["labels.y"] is None and unpacked_uuids(bytes(out["a"].stacktrace)) == ids
    assert out["a"]["values"] == [1, 2]
    assert sorted(rows_from_frame(t.read(), Sample), key=lambda r: r.example_type) == [Sample("a", {"x": "1"}, ids, 5, [1, 2]), Sample("b", {"y": "2"}, [], 6, [])]
    assert TableSchema.from_frame("sample", t.read(), ("labels",)).definition("labels").type == "string"


def test_nested_types(spark, tmp_path):
    schema = TableSchema("nested", (ColumnDef("labels", "struct<a:string,b:string>", True), ColumnDef("values", "list<int64>", True)))
    t = Store(spark, f"file://{tmp_path}").table("db", schema)
    t.insert(spark.createDataFrame([(("x", None), [1, 2])], "labels struct<a:string,b:string>, values array<long>"))
    assert rows(t.query().filter(col("labels.a").eq("x")).project(col("labels.a"), col("values")).frame()) == [("x", [1, 2])]
    assert TableSchema.from_frame("nested", t.read()).definition("labels").type == "struct<a:string,b:string>"


def test_expand_maps(spark):
    df = spark.createDataFrame([(1, {"b": 1, "a": 2}), (2, None)], "id long, m map<string,long>")
    assert expand_maps(df, "m").columns == ["id", "m.a", "m.b"] and rows(expand_maps(df, "m")) == [(1, 2, 1), (2, None, None)]


def test_block_folder(spark, tmp_path):
    folder = BlockFolder(spark, f"file://{tmp_path}")
    for k in range(3):
        folder.upload(f"db/t/{k:03d}", spark.createDataFrame([(k,)], f"{'a' if k else 'b'} long"))
    assert folder.scan("db/t").columns and folder.scan("db/t", before="002").count() == 2
    assert rows(folder.scan("db/t", col("a").gt(1)).select("a")) == [(2,)]
    folder.delete("db/t/000")
    assert folder.prefixes("db/t") == ["001", "002"]
    assert folder.scan("db/none").count() == 0 and folder.scan("db/none").columns == []


def test_a_scan_of_blocks_opens_those_that_may_hold_rows(spark, tmp_path):
    folder = BlockFolder(spark, f"file://{tmp_path}")
    for k in range(4):
        folder.upload(f"db/t/{k}", spark.createDataFrame([(10 * k + j, f"s{k}", None) for j in range(10)], "v long, s string, none string"))
    spark.createDataFrame([(25, "other", None, 1.5)], "v long, s string, none string, x double").write.parquet(f"{tmp_path}/db/t/9")  # without a manifest
    read = lambda e: len({f.split("/")[-2] for f in folder.scan("db/t", e).inputFiles()})
    assert read(None) == 5 and read(col("v").gt(25)) == 3 and read(col("v").lt_eq(9)) == 2 and read(and_(col("v").gt(5), col("s").eq("s1"))) == 2
    assert read(or_(col("v").eq(3), col("v").eq(33))) == 3 and read(Not(col("v").gt(25))) == 5 and read(col("none").eq("x")) == 1 and read(col("v").not_eq(3)) == 5
    assert rows(folder.scan("db/t", col("v").eq(25)).select("v", "s", "x")) == [(25, "other", 1.5), (25, "s2", None)]


def test_iceberg_needs_its_jar(spark):
    with pytest.raises(ValueError):
        IcebergTable(spark, "c.db.t")


def test_schema_scan(spark):
    q = Engine(spark, {"t": spark.createDataFrame([(1, 2)], "`labels.a` long, b long")}).scan_schema("t")
    assert rows(q.filter(col("name").regex(r"^labels\..+$")).distinct(col("name")).frame()) == [("labels.a",)]


def test_tools(spark, tmp_path):
    from tessera import tools

    path = str(tmp_path / "f.parquet")
    spark.createDataFrame([(1, "x"), (2, "y")], "`a.b` long, s string").coalesce(1).write.parquet(path)
    (file,) = (str(p) for p in (tmp_path / "f.parquet").glob("*.parquet"))
    assert tools.stats(file)["rows"] == 2 and tools.row_groups(file)[0]["columns"]["s"]["max"] == "y"
    assert rows(tools.find(spark, path, "a.b", "2")) == [(2, "y")]
    assert tools.row(spark, path, 1) == {"a.b": 2, "s": "y"} and tools.row(spark, path, 2) is None
    remote = f"file://{file}"
    assert tools.stats(remote, spark) == tools.stats(file) and tools.row_groups(remote, spark) == tools.row_groups(file)
    t = numbers(spark, tmp_path / "store")
    assert [v["version"] for v in tools.snapshots(t)] == [1, 2] and tools.snapshots(t)[1]["recent"] == 2
    assert [sorted(c) for c in tools.changes(t)] == [["blocks", "fields", "gone", "recent"]] * 2
    tools.reencode(spark, path, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == 2


def test_streaming(spark, tmp_path):
    from tessera.streaming import run_query, start_ingest

    spark.createDataFrame([(1, "a"), (2, "b")], "v long, k string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("v long, k string").parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        run_query(stream, Query.on(stream).limit(1))
    t = Store(spark, f"file://{tmp_path}/store").table("db", TableSchema("s", (ColumnDef("v", "int64"), ColumnDef("k"))))
    running = start_ingest(run_query(stream, Query.on(stream).filter(col("v").gt(1))), t, str(tmp_path / "ck"))
    running.processAllAvailable()
    running.stop()
    assert rows(t.read().select("v", "k")) == [(2, "b")]


def test_rollups_of_several_batches(spark, tmp_path):
    from tessera.streaming import rolled_up, rollup, start_rollup

    source, out = str(tmp_path / "in"), rollup
    schema = "t timestamp, k string"
    for part, days in enumerate(((1, 1, 2), (2, 3), (3, 3))):
        spark.createDataFrame([(datetime(2024, 1, d, 5), "x") for d in days], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        rows_ = out(stream, "t", "1 day", "10 days", ["k"], [F.count(F.lit(1)).alias("n")])
        start_rollup(rows_, str(tmp_path / "out"), str(tmp_path / "ck"), available_now=True).awaitTermination()
    got = rolled_up(spark, str(tmp_path / "out"), ["k"]).select("k", "n").collect()
    assert sorted(r.n for r in got) == [2, 2, 3]


def test_min_of_expression(spark):
    q = on(spark, [(1, 5), (2, 3)], "a long, b long")
    assert q.aggregate([min_(add(col("a"), col("b")))]).frame().collect()[0].asDict() == {"min(a + b)": 5}
