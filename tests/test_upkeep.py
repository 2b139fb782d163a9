"""Upkeep of stored tables: sweeps, re-clustering, checks before a commit, the snapshots' index."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from stratum.operators import layout
from stratum.plans.increment import apply_increment
from stratum.plans.project import Project
from stratum.plans.snapshots import SnapshotTable
from stratum.plans.store import CheckFailed, TableStore
from stratum.types import Field

NOW = dt.timedelta(0)


def frame(spark, ids, v="a"):
    return spark.createDataFrame([(i, v) for i in ids], "id long, v string").coalesce(1)


def test_a_sweep_leaves_every_readable_version_whole(spark, tmp_path):
    store = TableStore(spark, str(tmp_path), keep_versions=3)
    store.write("t", frame(spark, range(100)).repartitionByRange(5, "id"))
    for i in range(5):
        apply_increment(store, "t", frame(spark, [20 * i, 500 + i], f"v{i}"), "merge", "id")
    before = {v: sorted(map(tuple, store.read("t", version=v).collect())) for v in store.kept_versions("t")}
    report = store.unreachable_files("t", older_than=NOW)
    paths = {r["path"] for r in report.collect()}
    assert paths and store.unreachable_files("t").count() == 0   # all too young for the default
    assert store.sweep("t", older_than=NOW) == len(paths) and store.unreachable_files("t", older_than=NOW).count() == 0
    assert {v: sorted(map(tuple, store.read("t", version=v).collect())) for v in before} == before and len(before) == 3
    rows, parts = layout.apply_partitioning(frame(spark, range(40)), layout.RangePartitioning("id", 0, 40, 10))
    store.write("p", rows, partition_by=parts)
    store.keep_versions = 1
    store.replace_partitions("p", rows.filter("id < 5"), [f"{parts[0]}=0"])
    assert {r["part"] for r in store.unreachable_files("p", older_than=NOW).collect()} == {f"{parts[0]}=0"}
    store.sweep("p", older_than=NOW)
    assert store.read("p").count() == 35 and sum(f.endswith(".parquet") for _, _, fs in os.walk(tmp_path / "p") for f in fs) >= 4


def test_reclustering_bounds_the_folders(spark):
    store = TableStore(spark)
    store.write("t", frame(spark, range(0, 1000, 10)), cluster_by=["id"])
    counts = []
    for i in range(1, 10):
        store.append_rows("t", frame(spark, range(i, 1000, 10)))
        store.recluster("t")
        counts.append(len(store.entries("t")))
    assert sorted(r["id"] for r in store.read("t").collect()) == list(range(1000)) and max(counts) <= 4
    before = store.info("t")["version"]
    store.append_rows("t", frame(spark, range(5000, 5100)))   # overlaps nothing
    assert store.recluster("t") == [] or len(store.entries("t")) <= 4
    lookup = store.scan("t", "id = 5050")
    assert lookup.count() == 1 and store.info("t")["version"] > before
    store.write("u", frame(spark, [1]))
    with pytest.raises(ValueError):
        store.recluster("u")


def test_checks_stop_the_commit(spark):
    store = TableStore(spark)
    store.write("t", frame(spark, [1, 2]), unique_key=["ID"], required=["v"])
    for bad, options in ((frame(spark, [1, 1, None]), {"unique_key": ["id"]}), (frame(spark, [1], None), {"required": ["v"]})):
        with pytest.raises(CheckFailed, match="version before stays"):
            store.write("t", bad, **options)
    assert store.info("t")["version"] == 1 and store.read("t").count() == 2
    store.write("t", frame(spark, [None, None, 3]), unique_key=["id"])   # NULL keys equal nothing
    rows, parts = layout.apply_partitioning(frame(spark, [1, 11, 11]), layout.RangePartitioning("id", 0, 40, 10))
    with pytest.raises(CheckFailed):
        store.write("p", rows, partition_by=parts, unique_key=["id"])
    assert not store.exists("p")


def test_a_model_with_repeated_keys_keeps_its_old_version(spark):
    p = Project(spark, vars={"rows": [1, 2]})
    p.model("m", lambda c: frame(spark, c.var("rows")), materialized="incremental", unique_key="id", incremental_strategy="delete+insert",
            contract=[Field("id", "INT64", "REQUIRED"), Field("v", "STRING")])
    p.run()
    p.vars["rows"] = [2, 3, 3]
    with pytest.raises(CheckFailed, match="repeats"):
        p.run()
    assert sorted(r["id"] for r in p.store.read("m").collect()) == [1, 2]
    p.vars["rows"] = [2, 3]
    p.run()
    assert sorted(r["id"] for r in p.store.read("m").collect()) == [1, 2, 3]


def test_snapshot_reads_list_only_folders_that_can_matter(spark, monkeypatch):
    st = SnapshotTable(TableStore(spark), "s", "id", "at", ts_type="timestamp_ntz", auto_optimize=False)
    for run in range(5):
        src = spark.range(10).select("id", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.when(F.col("id") <= run, run).otherwise(0))).alias("at"))
        st.run(src, f"2024-01-0{run + 1} 12:00:00")
    closed = [e for e in st.entries() if e.part == "closed"]
    assert len(closed) == 4 and len([e for e in st.entries() if e.part == "open"]) == 1
    assert len(st.open_rows().inputFiles()) < len(st.read().inputFiles())
    whole = st.read()
    for day in range(0, 8):
        when = f"2024-01-0{day + 1} 13:00:00" if day < 7 else "2023-01-01 00:00:00"
        at = F.lit(when).cast("timestamp_ntz")
        want = whole.filter((F.col("dbt_valid_from") <= at) & (F.col("dbt_valid_to").isNull() | (F.col("dbt_valid_to") > at)))
        assert sorted(map(tuple, st.as_of(when).collect())) == sorted(map(tuple, want.collect()))
    assert len(st._entries_at(int(dt.datetime(2024, 1, 6, tzinfo=dt.timezone.utc).timestamp() * 1e6))) == 1   # later than all closings: open rows alone
    assert not st._entries_at(0)
    st.store.sweep("s", older_than=NOW)
    assert sorted(map(tuple, st.read().collect())) == sorted(map(tuple, whole.collect()))
