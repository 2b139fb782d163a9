"""Project graph, materializations, store, layout and sources."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratum.operators import layout, stats
from stratum.plans.project import Project, ProjectError
from stratum.plans.store import TableStore
from stratum.sources import files, jdbc


def small_project(spark):
    p = Project(spark, vars={"min": 2})
    p.add_source("raw", {"nums": lambda: spark.range(10).withColumnRenamed("id", "n")})
    return p


def test_unknown_names_list_what_exists(spark):
    p = small_project(spark)
    with pytest.raises(ProjectError, match="declared groups"):
        p.source("nope", "nums")
    with pytest.raises(ProjectError, match="declared"):
        p.source("raw", "nope")
    with pytest.raises(ProjectError, match="known vars"):
        p.var("nope")
    p.model("a", lambda c: c.ref("ghost"), materialized="ephemeral")
    with pytest.raises(ProjectError, match="unknown model 'ghost'"):
        p.run(["a"])


def test_cycle_is_an_error(spark):
    p = small_project(spark)
    p.model("a", lambda c: c.ref("b"), materialized="ephemeral")
    p.model("b", lambda c: c.ref("a"), materialized="ephemeral")
    with pytest.raises(ProjectError, match="cycle"):
        p.run(["a"])


def test_diamond_builds_shared_upstream_once(spark):
    p = small_project(spark)
    calls = []

    def base(c):
        calls.append(1)
        return c.source("raw", "nums")
    p.model("base", base, materialized="ephemeral")
    p.model("l", lambda c: c.ref("base").filter("n < 5"), materialized="ephemeral")
    p.model("r", lambda c: c.ref("base").filter("n >= 5"), materialized="ephemeral")
    p.model("both", lambda c: c.ref("l").unionByName(c.ref("r")), materialized="table")
    out = p.run(["both"])["both"]
    assert out.count() == 10 and len(calls) == 1


def test_config_validation(spark):
    p = small_project(spark)
    with pytest.raises(ProjectError):
        p.model("x", lambda c: None, materialized="incremental")
    with pytest.raises(ProjectError):
        p.model("y", lambda c: None, materialized="incremental", unique_key="n",
                incremental_strategy="upsert")
    with pytest.raises(ProjectError):
        p.model("z", lambda c: None, cluster_by=["a", "b", "c", "d", "e"])
    p.model("ok", lambda c: None, materialized="incremental", incremental_strategy="append")


def test_incremental_runs_and_versions(spark):
    p = small_project(spark)
    p.model("inc", lambda c: c.high_water(c.source("raw", "nums"), "n"),
            materialized="incremental", unique_key="n")
    first = p.run(["inc"])["inc"]
    assert first.count() == 10
    p.sources["raw"]["nums"] = lambda: spark.range(15).withColumnRenamed("id", "n")
    second = p.run(["inc"])["inc"]
    assert second.count() == 15
    assert p.store.info("inc")["version"] == 2
    assert p.store.read("inc", version=1).count() == 10


def test_sql_model_with_vars(spark):
    p = small_project(spark)
    p.sql_model("big", "SELECT n FROM {nums} WHERE n >= :min", sources={"nums": ("raw", "nums")},
                materialized="view")
    assert p.run(["big"])["big"].count() == 8


def test_required_partition_filter_and_expiry(spark):
    store = TableStore(spark)
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 3, 1))],
                               "id long, ts timestamp_ntz")
    df, cols = layout.apply_partitioning(df, layout.TimePartitioning("ts", "DAY"))
    store.write("t", df, partition_by=cols, require_partition_filter=True)
    with pytest.raises(layout.PartitionFilterRequired):
        store.scan("t")
    with pytest.raises(layout.PartitionFilterRequired):
        store.scan("t", F.col("id") > 0)
    assert store.scan("t", "_partition_time >= DATE'2024-02-01'").count() == 1
    kept = store.expire_partitions("t", 30, dt.datetime(2024, 3, 15))
    assert [r.id for r in kept.collect()] == [2]


def test_range_and_time_buckets(spark):
    df = spark.createDataFrame([(None,), (-1,), (0,), (9,), (10,), (40,)], "x long")
    got = [r[0] for r in df.select(layout.range_bucket(F.col("x"), 0, 40, 10)).collect()]
    assert got == [None, layout.RANGE_UNPARTITIONED, 0, 0, 10, layout.RANGE_UNPARTITIONED]
    with pytest.raises(layout.LayoutError):
        layout.RangePartitioning("x", 0, 10, 0)
    with pytest.raises(layout.LayoutError):
        layout.table_expired(dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1), True)
    assert layout.table_expired(dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1))


def test_byte_cap(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    with pytest.raises(stats.ByteCapExceeded):
        stats.enforce_byte_cap(df, 10)
    assert stats.enforce_byte_cap(df, 10 ** 12) > 0
    with pytest.raises(ValueError):
        stats.enforce_byte_cap(df, 0)


def test_source_checks(spark):
    with pytest.raises(jdbc.JdbcConfigError):
        jdbc.check_connection("oracle", "jdbc:sqlserver://h")
    with pytest.raises(jdbc.JdbcConfigError):
        jdbc.check_connection("db2", "jdbc:db2://h")
    assert jdbc.check_connection("Postgres", "jdbc:postgresql://h/db") == "postgres"
    with pytest.raises(files.ExternalConfigError):
        files.read_external(spark, [], "CSV")
    rows = files.inline_rows(spark, [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}])
    assert rows.count() == 2


def test_partitioned_versions_share_untouched_directories(spark):
    store = TableStore(spark)
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 2, 1)),
                                (3, dt.datetime(2024, 3, 1))], "id long, ts timestamp_ntz")
    df, cols = layout.apply_partitioning(df, layout.TimePartitioning("ts", "MONTH"))
    store.write("p", df, partition_by=cols)
    v1_paths = {r.path for r in spark.read.parquet(store.info("p")["manifest"]).collect()}
    new = spark.createDataFrame([(20, dt.datetime(2024, 2, 5))], "id long, ts timestamp_ntz")
    new, _ = layout.apply_partitioning(new, layout.TimePartitioning("ts", "MONTH"))
    out = store.replace_partitions("p", new, ["_partition_time=2024-02-01"])
    assert sorted(r.id for r in out.collect()) == [1, 3, 20]
    v2_paths = {r.path for r in spark.read.parquet(store.info("p")["manifest"]).collect()}
    assert len(v1_paths & v2_paths) == 2          # January and March carried over
    assert sorted(r.id for r in store.read("p", version=1).collect()) == [1, 2, 3]
    store.replace_partitions("p", new.limit(0), [])  # empty append: nothing changes
    assert store.read("p").count() == 3
    kept = store.expire_partitions("p", 20, dt.datetime(2024, 3, 10))
    # cutoff 2024-02-19: the January and February partitions expire
    assert sorted(r.id for r in kept.collect()) == [3]
    # expiry is metadata only: the files of older versions are still readable
    assert store.read("p", version=1).count() == 3


def test_more_config_rules(spark):
    p = small_project(spark)
    with pytest.raises(ProjectError, match="require_partition_filter"):
        p.model("a", lambda c: None, require_partition_filter=True)
    with pytest.raises(ProjectError, match="partition_expiration_days"):
        p.model("b", lambda c: None, partition_expiration_days=3)
    with pytest.raises(ProjectError, match="enable_refresh"):
        p.model("c", lambda c: None, enable_refresh=True)
    with pytest.raises(ProjectError, match="refresh_interval"):
        p.model("d", lambda c: None, materialized="materialized_view",
                refresh_interval=dt.timedelta(hours=1))
    with pytest.raises(ProjectError, match="deletion_protection"):
        p.model("e", lambda c: None, deletion_protection=True,
                expiration_time=dt.datetime(2030, 1, 1))


def test_expiry_with_dataset_defaults(spark):
    p = Project(spark, default_partition_expiration_days=40,
                default_table_expiration=dt.timedelta(days=10))
    rows = [(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 3, 1))]
    p.add_source("raw", {"t": lambda: spark.createDataFrame(rows, "id long, ts timestamp_ntz")})
    p.model("part", lambda c: c.source("raw", "t"),
            partition_by=layout.TimePartitioning("ts", "DAY"))
    p.model("kept", lambda c: c.source("raw", "t"), deletion_protection=True)
    out = p.run(run_ts=dt.datetime(2024, 3, 15))
    assert [r.id for r in out["part"].collect()] == [2]
    gone = p.expire_tables(as_of=dt.datetime(2030, 1, 1))
    assert gone == ["part"] and p.store.exists("kept")


def test_evolve_table_guards_consumer_keys(spark):
    from stratum.types import Field
    p = small_project(spark)
    p.model("base", lambda c: c.source("raw", "nums").withColumn("m", F.col("n") % 3),
            materialized="table")
    p.model("agg", lambda c: c.ref("base").groupBy("m").count(), materialized="incremental",
            unique_key="m")
    p.run()
    assert p.consumers("base") == ["agg"]
    from stratum.types import SchemaError
    with pytest.raises(SchemaError, match="agg"):
        p.evolve_table("base", [Field("m", alter="delete")])
    out = p.evolve_table("base", [Field("k", "INT64", alter="rename", alter_from="n"),
                                  Field("m", "INT64")])
    assert out.columns == ["k", "m"] and p.store.info("base")["version"] == 2


def test_retry_after_a_crash_before_commit(spark):
    store = TableStore(spark)
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    store.write("t", df)
    # a run that wrote version 2's files and died before repointing
    spark.createDataFrame([(9, "junk")], "id long, v string").write.parquet(f"{store.root}/t/v=2")
    assert [r.id for r in store.read("t").collect()] == [1]
    out = store.write("t", df.union(spark.createDataFrame([(2, "b")], "id long, v string")))
    assert sorted(r.id for r in out.collect()) == [1, 2]


def test_ref_of_flagged_table_needs_partition_filter(spark):
    p = Project(spark)
    rows = [(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 3, 1))]
    p.add_source("raw", {"t": lambda: spark.createDataFrame(rows, "id long, ts timestamp_ntz")})
    p.model("events", lambda c: c.source("raw", "t"), require_partition_filter=True,
            partition_by=layout.TimePartitioning("ts", "MONTH"))
    p.model("bad", lambda c: c.ref("events"), materialized="ephemeral")
    p.model("good", lambda c: c.ref("events", partition_filter="_partition_time >= DATE'2024-02-01'"),
            materialized="ephemeral")
    with pytest.raises(layout.PartitionFilterRequired):
        p.run(["bad"])
    assert [r.id for r in p.run(["good"])["good"].collect()] == [2]


def test_partitioned_merge_handles_moved_keys_and_stable_fast_path(spark):
    rows1 = [(1, dt.datetime(2024, 1, 5)), (2, dt.datetime(2024, 2, 5))]
    rows2 = [(1, dt.datetime(2024, 3, 5))]            # key 1 moves from January to March
    for stable, expect in ((False, [(1, 3), (2, 2)]), (True, [(1, 1), (1, 3), (2, 2)])):
        p = Project(spark, vars={"run": 1})
        p.add_source("raw", {"t": lambda p=p: spark.createDataFrame(
            rows1 if p.var("run") == 1 else rows2, "id long, ts timestamp_ntz")})
        p.model("m", lambda c: c.source("raw", "t"), materialized="incremental",
                unique_key="id", partition_by=layout.TimePartitioning("ts", "MONTH"),
                partition_keys_stable=stable)
        p.run()
        p.vars["run"] = 2
        out = p.run()["m"]
        got = sorted((r.id, r.ts.month) for r in out.collect())
        # exact by default; the fast path trusts that keys never move
        assert got == expect


def test_unwired_ref_in_sql_model_is_an_error(spark):
    p = small_project(spark)
    p.sql_model("a", "SELECT n FROM {nums}", sources={"nums": ("raw", "nums")},
                materialized="ephemeral")
    p.sql_model("b", "SELECT * FROM {a} JOIN {ghost} USING (n)", refs=["a"],
                materialized="ephemeral")
    with pytest.raises(ProjectError, match="ghost.*not wired"):
        p.run(["b"])


def test_cluster_groups_and_sorts(spark):
    df = spark.range(200).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    out = layout.cluster(df, ["k"])
    rows = out.collect()
    assert len(rows) == 200
    with pytest.raises(layout.LayoutError):
        layout.cluster(df, ["k", "v", "k", "v", "k"])
    # inside each output partition the keys are sorted
    sorted_within = out.withColumn("pid", F.spark_partition_id())
    for r in sorted_within.groupBy("pid").agg(F.collect_list("k").alias("ks")).collect():
        assert r.ks == sorted(r.ks)


def test_partitioned_incremental_starting_empty(spark):
    p = Project(spark, vars={"run": 1})
    rows = [(1, dt.datetime(2024, 1, 5)), (2, dt.datetime(2024, 2, 5))]
    p.add_source("raw", {"t": lambda: spark.createDataFrame(
        [] if p.var("run") == 1 else rows, "id long, ts timestamp_ntz")})
    p.model("m", lambda c: c.source("raw", "t"), materialized="incremental", unique_key="id",
            partition_by=layout.TimePartitioning("ts", "MONTH"))
    assert p.run()["m"].count() == 0
    p.vars["run"] = 2
    assert sorted(r.id for r in p.run()["m"].collect()) == [1, 2]


def test_evolution_is_metadata_only_and_composes(spark):
    import glob
    from stratum.types import Field
    store = TableStore(spark)
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, name string, city string")
    store.write("e", df)
    files_before = sorted(glob.glob(f"{store.root}/e/**/*.parquet", recursive=True))
    store.evolve("e", [Field("full_name", alter="rename", alter_from="name"),
                       Field("city", alter="delete"),
                       Field("src", "STRING", alter="insert", default_value_expression="'old'")],
                 backfill=True)
    out = store.evolve("e", [Field("nm", alter="rename", alter_from="full_name")])
    assert out.columns == ["id", "nm", "src"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", "old"), (2, "b", "old")]
    assert sorted(glob.glob(f"{store.root}/e/**/*.parquet", recursive=True)) == files_before
    # a full write stores the evolved columns and drops the projection
    again = store.write("e", out.filter("id = 1"))
    assert again.columns == ["id", "nm", "src"] and store.info("e")["projection"] is None


def test_partitioned_evolution_mixes_old_and_new_directories(spark):
    from stratum.types import Field
    store = TableStore(spark)
    rows = [(1, "a", dt.datetime(2024, 1, 1)), (2, "b", dt.datetime(2024, 2, 1))]
    df, cols = layout.apply_partitioning(
        spark.createDataFrame(rows, "id long, name string, ts timestamp_ntz"),
        layout.TimePartitioning("ts", "MONTH"))
    store.write("pe", df, partition_by=cols)
    store.evolve("pe", [Field("label", alter="rename", alter_from="name"),
                        Field("n", "INT64", alter="insert")])
    # February is rewritten after the evolution, January keeps its old files
    new, _ = layout.apply_partitioning(
        spark.createDataFrame([(3, "c", dt.datetime(2024, 2, 9), 7)],
                              "id long, label string, ts timestamp_ntz, n long"),
        layout.TimePartitioning("ts", "MONTH"))
    store.replace_partitions("pe", new.select(*store.read("pe").columns),
                             ["_partition_time=2024-02-01"])
    out = store.evolve("pe", [Field("tag", alter="rename", alter_from="label")])
    got = sorted((r.id, r.tag, r.n) for r in out.collect())
    assert got == [(1, "a", None), (3, "c", 7)]


def test_incremental_merge_after_metadata_evolution(spark):
    from stratum.types import Field
    p = Project(spark, vars={"run": 1})
    first = [(1, "a", dt.datetime(2024, 1, 5)), (2, "b", dt.datetime(2024, 2, 5))]
    later = [(2, "B", dt.datetime(2024, 2, 5), 9), (3, "c", dt.datetime(2024, 3, 5), 1)]
    p.add_source("raw", {"t": lambda: (
        spark.createDataFrame(first, "id long, name string, ts timestamp_ntz")
        if p.var("run") == 1 else
        spark.createDataFrame(later, "id long, label string, ts timestamp_ntz, score long"))})
    p.model("m", lambda c: c.source("raw", "t"), materialized="incremental", unique_key="id",
            partition_by=layout.TimePartitioning("ts", "MONTH"))
    p.run()
    p.evolve_table("m", [Field("label", alter="rename", alter_from="name"),
                         Field("score", "INT64", alter="insert")])
    p.vars["run"] = 2
    out = p.run()["m"]
    got = sorted((r.id, r.label, r.score) for r in out.collect())
    assert got == [(1, "a", None), (2, "B", 9), (3, "c", 1)]


def test_snapshots_are_consumers(spark):
    from pyspark.sql import functions as F

    from stratum.plans.project import Project, ProjectError
    from stratum.types import Field, SchemaError
    p = Project(spark)
    p.model("base", lambda c: spark.range(3).select("id", F.lit("2024-01-01").cast("timestamp_ntz").alias("at"), F.lit(1).alias("v")), materialized="table")
    p.snapshot("base_history", "base", "id", "at", ts_type="timestamp_ntz")
    p.run()
    assert p.run_snapshot("base_history", "2024-01-02 00:00:00").count() == 3 and p.consumers("base") == ["base_history"]
    for column, role in (("id", "unique key"), ("at", "version column")):
        with pytest.raises(SchemaError, match=f"base_history.*{role}"):
            p.evolve_table("base", [Field(column, "INT64", alter="delete")])
    p.evolve_table("base", [Field("v", "INT64", alter="delete")])
    with pytest.raises(ProjectError, match="twice"):
        p.snapshot("base_history", "base", "id", "at")
