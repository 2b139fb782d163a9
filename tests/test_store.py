"""Stored tables: conflicting writers, touched files, statistics of folders, layout through renames."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stratum.operators import layout, profile, stats
from stratum.plans.increment import apply_increment
from stratum.plans.project import Project
from stratum.plans.store import CommitConflict, TableStore
from stratum.types import Field

SCHEMA = "id long, v string, t timestamp_ntz"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def frame(spark, ids, v="a", files=1):
    rows = [(i, v, dt.datetime(2024, 1, 1) + dt.timedelta(days=i or 0)) for i in ids]
    return spark.createDataFrame(rows, SCHEMA).repartitionByRange(files, "id")


def test_second_writer_is_refused_and_loses_nothing(spark, tmp_path):
    one = TableStore(spark, str(tmp_path), "conflicts")
    two = TableStore(spark, str(tmp_path), "conflicts")
    one.write("t", frame(spark, [0]))
    read = two.info("t")
    one.append_rows("t", frame(spark, range(1, 101)))
    with pytest.raises(CommitConflict):
        two.replace_entries("t", read, two._entries(read), frame(spark, range(200, 400)))
    assert two.read("t").count() == 101
    two.append_rows("t", frame(spark, range(200, 400)))   # run again
    assert one.read("t").count() == 301


def test_merge_rewrites_touched_files_only(spark):
    store = TableStore(spark)
    store.write("t", frame(spark, range(100), files=10))
    store.append_rows("t", frame(spark, range(100, 200), files=10))
    folder = store.entries("t")[1].path
    before = {f for e in store.entries("t") for f in store.files("t", e)}
    assert len(before) == 20
    out = apply_increment(store, "t", frame(spark, [5, 7, 500], "new"), "merge", "id")
    want = {i: "a" for i in range(200)} | {5: "new", 7: "new", 500: "new"}
    assert {r["id"]: r["v"] for r in out.collect()} == want and out.count() == 201
    after = {f for e in store.entries("t") for f in store.files("t", e)}
    assert len(before - after) == 1 and folder in {e.path for e in store.entries("t")}
    out = apply_increment(store, "t", frame(spark, [5, 6, 5], "b"), "delete+insert", "id")
    assert sorted(r["v"] for r in out.filter("id in (5, 6)").collect()) == ["b"] * 3 and out.count() == 202
    kept = {e.path for e in store.entries("t")}
    out = apply_increment(store, "t", frame(spark, [6, 700], "c"), "insert_only", "id")
    assert kept < {e.path for e in store.entries("t")} and out.filter("v = 'c'").count() == 1   # nothing is rewritten
    assert store.read("t", version=2).count() == 200


@pytest.mark.parametrize("strategy,options", [("merge", {"on_duplicate": "keep"}), ("merge", {"on_duplicate": "newest", "order_by": "t"}), ("delete+insert", {}), ("insert_only", {})])
def test_touched_files_equal_the_whole_table(spark, strategy, options):
    from stratum.operators import strategies
    rng = random.Random(len(strategy + str(options)))
    ids = lambda n: [rng.choice([None, *range(30)]) for _ in range(n)]
    first = frame(spark, ids(40), "x", files=5)
    store = TableStore(spark)
    store.write("t", first)
    want = spark.createDataFrame(first.collect(), SCHEMA)
    for step in range(3):
        s = frame(spark, ids(4), f"s{step}")
        want = spark.createDataFrame(strategies.apply_strategy(strategy, want, s, "id", **options).collect(), SCHEMA)
        got = apply_increment(store, "t", s, strategy, "id", **options)
        assert rows_of(got) == rows_of(want)


def test_statistics_equal_a_scan(spark):
    store = TableStore(spark)
    big = "x" * 300
    df = spark.sql(f"""SELECT id, cast(id % 3 as double) / 0.7 AS x, if(id = 4, null, concat('t', id)) AS s, timestamp_ntz'2024-01-01 00:00:00' AS n,
        timestamp'2024-02-01 00:00:00.5' AS z, date'1969-12-30' AS d, cast(id as decimal(9,2)) AS e, array(id, null) AS a, if(id = 2, 'nan', '1') AS w, '{big}' AS long FROM range(20)""")
    df = df.withColumn("f", F.when(F.col("w") == "nan", F.lit(float("nan"))).otherwise(F.col("x"))).withColumn("none", F.lit(None).cast("int"))
    store.write("t", df)
    store.append_rows("t", df.withColumn("id", F.col("id") + 100).withColumn("d", F.lit("2024-01-01").cast("date")))

    def same():
        table = store.read("t")
        scan = profile.from_row(table.schema, table.agg(*profile.aggregates(table)).first())
        assert store.statistics("t") == scan
        want = rows_of(stats.table_stats("t", table))
        assert rows_of(store.table_stats("t")) == want
        for f in table.schema:
            if profile.bounded(f.dataType):
                one = spark.range(1).select(store.bound("t", f.name).alias("high"), store.bound("t", f.name, least=True).alias("low"))
                assert str(one.first()) == str(table.agg(F.max(f.name).alias("high"), F.min(f.name).alias("low")).first())
    same()
    apply_increment(store, "t", df.filter("id = 3").withColumn("x", F.lit(99.0)), "merge", "id")
    assert any(e.stats is None for e in store.entries("t")) or len(store.entries("t")) == 2
    same()
    store.evolve("t", [Field("y", "FLOAT64", alter="rename", alter_from="x"), Field("extra", "INT64", alter="insert")])
    same()
    store.evolve("t", [Field("filled", "INT64", alter="insert", default_value_expression="7")], backfill=True)
    same()


def test_statistics_by_partition_need_no_scan(spark, monkeypatch):
    store = TableStore(spark)
    rows, parts = layout.apply_partitioning(frame(spark, range(40)).withColumn("id", F.when(F.col("id") != 7, F.col("id"))), layout.RangePartitioning("id", 0, 40, 10))
    store.write("t", rows, partition_by=parts)
    store.append_rows("t", rows.filter("id > 25"))
    want = rows_of(stats.table_stats("t", store.read("t"), parts))
    scans = []
    monkeypatch.setattr(TableStore, "read_entries", lambda *a, **k: scans.append(a))
    assert rows_of(store.table_stats("t", per_partition=True)) == want and not scans
    assert spark.range(1).select(store.bound("t", "id")).first()[0] == 39 and not scans


def test_high_water_reads_no_stored_row(spark, monkeypatch):
    p = Project(spark, vars={"n": 5})

    @p.model("m", materialized="incremental", unique_key="id")
    def m(ctx):
        return ctx.high_water(frame(spark, range(p.var("n"))), "t")
    p.run()
    p.vars["n"] = 9
    from stratum.plans.project import Context
    reads = []
    monkeypatch.setattr(TableStore, "read", lambda *a, **k: reads.append(a))
    monkeypatch.setattr(TableStore, "read_entries", lambda *a, **k: reads.append(a))
    new = p.models["m"].build(Context(p, p.models["m"], incremental=True))
    assert sorted(r["id"] for r in new.collect()) == [5, 6, 7, 8] and not reads


def test_layout_follows_renames(spark):
    store = TableStore(spark)
    store.write("c", frame(spark, range(10)), cluster_by=["id"], column_comments={"id": "key"})
    store.evolve("c", renamed("id", "key", "INT64"))
    store.append_rows("c", frame(spark, range(10, 20)).withColumnRenamed("id", "key"))
    assert store.read("c").count() == 20 and store.info("c")["cluster_by"] == ["key"] and store.info("c")["columns"] == {"key": "key"}
    spec = layout.TimePartitioning("t", "DAY")
    rows, parts = layout.apply_partitioning(frame(spark, range(10)), spec)
    store.write("p", rows, partition_by=parts, extra=layout.described(spec))
    store.evolve("p", renamed("t", "at", "DATETIME"))
    got = store.scan_range("p", dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 4))
    assert sorted(r["id"] for r in got.collect()) == [2, 3] and "at" in got.columns
    with pytest.raises(ValueError, match="laid out"):
        store.evolve("p", [Field("at", "DATETIME", alter="delete")])


def renamed(old, new, kind):
    return [Field(new, kind, alter="rename", alter_from=old)]


def test_old_versions_leave_the_pointer(spark):
    store = TableStore(spark, keep_versions=3)
    store.write("t", frame(spark, [0]))
    for i in range(1, 6):
        store.append_rows("t", frame(spark, [i]))
    assert store.kept_versions("t") == [4, 5, 6] and store.read("t", version=4).count() == 4
    with pytest.raises(KeyError, match="no longer"):
        store.read("t", version=3)
    assert sum(k.startswith("stratum.at.") for k in store._props("t")) == 3


def test_empty_tables_have_statistics(spark):
    store = TableStore(spark)
    store.write("t", frame(spark, []))
    assert store.statistics("t").rows == 0 and spark.range(1).select(store.bound("t", "t")).first()[0] is None
    store.append_rows("t", frame(spark, [3]))
    assert spark.range(1).select(store.bound("t", "id")).first()[0] == 3
