"""Increments, streams and layouts outside the happy path."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratum.functions.helpers import listagg
from stratum.functions.macros import Macros
from stratum.operators import contracts, layout, strategies
from stratum.plans.project import Project, ProjectError
from stratum.plans.snapshots import SnapshotTable
from stratum.plans.store import TableStore
from stratum.session import scratch_path, table
from stratum.streaming.incremental import batch_writer, land, snapshot_writer, stream_incremental
from stratum.types import Field, align

SCHEMA = "id long, v string, t int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def model(spark, frames, **config):
    p = Project(spark)
    p.model("m", lambda ctx: frames[-1], materialized="incremental", **config)
    return p


@pytest.mark.parametrize("files", [1, None])
def test_stream_does_not_depend_on_batches(spark, files):
    store, landing = TableStore(spark), scratch_path(spark, "landing")
    for x in [(1, "a", 1), (1, "c", 3), (1, "b", 2), (2, "x", 1)]:
        land(spark.createDataFrame([x], SCHEMA).coalesce(1), landing)
    out = stream_incremental(spark, store, "t", landing, SCHEMA, "merge", "id",
                             max_files_per_trigger=files, order_by="t")
    assert rows_of(out) == [(1, "c", 3), (2, "x", 1)]


def test_stream_refuses_repeated_keys_without_an_order(spark):
    twice = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], SCHEMA)
    with pytest.raises(strategies.DuplicateKeyError):
        batch_writer(TableStore(spark), "t", "merge", "id")(twice, 0)


def test_failure_before_the_commit_then_replay(spark, monkeypatch):
    store = TableStore(spark)
    apply = batch_writer(store, "t", "append")
    apply(spark.createDataFrame([(1, "a", 1)], SCHEMA), 0)
    batch = spark.createDataFrame([(2, "b", 1)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(store, "_point", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            apply(batch, 1)
    for _ in range(2):
        apply(batch, 1)
    assert rows_of(store.read("t")) == [(1, "a", 1), (2, "b", 1)]


def test_stream_keeps_the_layout(spark):
    store = TableStore(spark)
    apply = batch_writer(store, "t", "merge", "id", partition_by=layout.RangePartitioning("id", 0, 100, 10),
                         column_comments={"v": "value"}, order_by="t")
    apply(spark.createDataFrame([(1, "a", 1), (25, "b", 1)], SCHEMA), 0)
    before = {e.path for e in store.entries("t")}
    apply(spark.createDataFrame([(1, "A", 2)], SCHEMA), 1)
    info = store.info("t")
    assert info["partition_by"] == [layout.RANGE_PARTITION_COLUMN] and info["columns"] == {"v": "value"}
    assert len(before & {e.path for e in store.entries("t")}) == 1
    assert rows_of(store.read("t").select("id", "v", "t")) == [(1, "A", 2), (25, "b", 1)]


def test_snapshot_of_changes_does_not_depend_on_batches(spark):
    changes = [(1, "a", 1), (1, "b", 2), (2, "x", 1), (1, "c", 5), (2, "x", 1)]
    got = []
    for cuts in ([changes], [[c] for c in changes]):
        st = SnapshotTable(TableStore(spark), "s", "id", "ts", ts_type="timestamp_ntz")
        apply = snapshot_writer(st)
        for i, rows in enumerate(cuts):
            apply(spark.createDataFrame([(k, v, dt.datetime(2024, 1, d)) for k, v, d in rows],
                                        "id long, v string, ts timestamp_ntz"), i)
            apply(spark.createDataFrame([], "id long, v string, ts timestamp_ntz"), i)   # a replayed id
        assert st.read().columns[:3] == ["id", "v", "ts"]
        got.append(rows_of(st.read()))
    assert got[0] == got[1] and len(got[0]) == 4
    assert sum(r[-1] is None for r in got[0]) == 2


def test_an_increment_is_evaluated_once(spark):
    first = spark.range(500).select("id", F.lit(0.0).alias("x"))
    changing = spark.range(5000).select((F.rand() * 500).cast("long").alias("id"), F.lit(1.0).alias("x")).distinct()
    frames = [first]
    p = model(spark, frames, unique_key="id", incremental_strategy="delete+insert")
    p.run()
    frames.append(changing.filter(F.rand() < 0.5))
    out = p.run()["m"]
    assert out.count() == out.select("id").distinct().count() == 500


def test_append_leaves_stored_files_alone(spark):
    frames = [spark.range(1000)]
    p = model(spark, frames, incremental_strategy="append")
    p.run()
    old = set(p.store.read("m").inputFiles())
    frames.append(spark.range(1000, 1001))
    out = p.run()["m"]
    new = set(out.inputFiles()) - old
    assert out.count() == 1001 and old < set(out.inputFiles())
    assert spark.read.parquet(*new).count() == 1
    assert p.store.read("m", version=1).count() == 1000


def test_new_columns(spark):
    frames = [spark.createDataFrame([(1, "a")], "id long, v string")]
    p = model(spark, frames, unique_key="id")
    p.run()
    frames.append(spark.createDataFrame([(2, "b", 7)], "id long, v string, extra long"))
    with pytest.raises(strategies.NewColumnsError):
        p.run()
    p.models["m"].config.on_schema_change = "append"
    assert rows_of(p.run()["m"]) == [(1, "a", None), (2, "b", 7)]
    assert p.store.read("m", version=1).columns == ["id", "v"]


def test_last_needs_an_order(spark):
    with pytest.raises(ProjectError):
        model(spark, [], unique_key="id", on_duplicate="last")


def test_old_versions_keep_their_columns(spark):
    store = TableStore(spark)
    store.write("t", spark.createDataFrame([(1, "a")], "id long, v string"))
    store.evolve("t", [Field("w", "STRING", alter="rename", alter_from="v")])
    store.append_rows("t", spark.createDataFrame([(2, "b")], "id long, w string"))
    assert rows_of(store.read("t")) == [(1, "a"), (2, "b")]
    assert [store.read("t", version=i).columns for i in (1, 2, 3)] == [["id", "v"], ["id", "w"], ["id", "w"]]
    assert rows_of(store.read("t", version=2)) == [(1, "a")]


def test_ranges_do_not_expire_but_time_partitions_do(spark):
    p = Project(spark)
    p.default_partition_expiration_days = 1
    p.model("r", lambda ctx: spark.range(1990010100, 1990010102), materialized="table",
            partition_by=layout.RangePartitioning("id", 0, 2_000_000_000, 10))
    days = spark.createDataFrame([(dt.datetime(2024, 1, d),) for d in (1, 30)], "ts timestamp_ntz")
    p.model("d", lambda ctx: days, materialized="table", partition_by=layout.TimePartitioning("ts", "DAY", 5))
    out = p.run(run_ts=dt.datetime(2024, 1, 31))
    assert out["r"].count() == 2 and out["d"].count() == 1


def test_field_bounds_prune_the_manifest(spark):
    p = Project(spark)
    days = spark.createDataFrame([(d, dt.datetime(2024, 1, d, 5)) for d in range(1, 11)], "id int, ts timestamp_ntz")
    p.model("d", lambda ctx: days, materialized="table", partition_by=layout.TimePartitioning("ts"),
            require_partition_filter=True)
    p.model("r", lambda ctx: spark.range(-5, 40), materialized="table",
            partition_by=layout.RangePartitioning("id", 0, 30, 10))
    p.run()
    got = p.store.scan_range("d", dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 4, 23))
    assert sorted(r.id for r in got.collect()) == [3, 4] and len(got.inputFiles()) == 2
    for low, high in ((12, 15), (-3, 4), (25, 35), (None, 3), (33, None)):
        want = [i for i in range(-5, 40) if (low is None or i >= low) and (high is None or i <= high)]
        assert sorted(r.id for r in p.store.scan_range("r", low, high).collect()) == want


def test_clustered_files_cover_disjoint_ranges(spark):
    store = TableStore(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.write("t", spark.range(20000).select((F.col("id") * 7919 % 20000).alias("k"), F.lit(1).alias("x")), cluster_by=["k"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spans = sorted(tuple(r) for r in store.read("t").groupBy(F.input_file_name().alias("f")).agg(F.min("k"), F.max("k")).select("min(k)", "max(k)").collect())
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_drift_counts_values_without_a_cast(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01' a, named_struct('x', 1) b UNION ALL SELECT NULL, NULL")
    got = contracts.drift("t", df, [Field("a", "INT64"), Field("b", "INT64")]).collect()
    assert [(r.kind, r.affected_rows) for r in got] == [("type_mismatch", 1)] * 2


def test_json_columns_meet_their_contract(spark):
    fields = [Field("j", "JSON")]
    aligned = align(spark.createDataFrame([("{}",)], "j string"), fields)
    assert contracts.drift("t", aligned, fields).count() == 0


def test_required_filter_must_refer_to_the_column(spark):
    df = spark.createDataFrame([(1, "p")], "p int, v string")
    assert layout.read_with_partition_filter(df, "p", F.col("p") == 1).count() == 1
    for no in (F.col("v") == "p", "v = 'p'"):
        with pytest.raises(layout.PartitionFilterRequired):
            layout.read_with_partition_filter(df, "p", no)


def test_fresh_materialized_view_builds_nothing_upstream(spark):
    built = []
    p = Project(spark)
    p.model("up", lambda ctx: built.append(1) or spark.range(1), materialized="table")
    p.model("mv", lambda ctx: ctx.ref("up"), materialized="materialized_view", enable_refresh=True,
            refresh_interval=dt.timedelta(minutes=10), max_staleness=dt.timedelta(hours=4))
    start = dt.datetime(2024, 1, 1)
    for minutes, n in ((0, 1), (5, 1), (60, 2)):
        p.run(["mv"], run_ts=start + dt.timedelta(minutes=minutes))
        assert len(built) == n


def test_drop_safety_before_the_first_run(spark):
    p = Project(spark)
    p.model("base", lambda ctx: spark.createDataFrame([(1, 2)], "id long, v long"), materialized="table")
    p.run(["base"])
    p.sql_model("down", "SELECT * FROM {base}", refs=["base"], materialized="incremental", unique_key="v")
    with pytest.raises(ValueError):
        p.evolve_table("base", [Field("v", "INT64", alter="delete")])


def test_small_semantics(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1), ("b", "x", 1)], "g string, m string, o int")
    got = dict(df.groupBy("g").agg(listagg(F.col("m"), ",", F.col("o")).alias("l")).collect())
    assert got == {"a": None, "b": "x"}
    deep = Macros()
    deep.define("m0", lambda c: c + 1)
    for i in range(1, 15):
        deep.define(f"m{i}", lambda c, i=i: deep(f"m{i - 1}", c))
    assert spark.range(1).select(deep("m14", F.col("id"))).first()[0] == 1
    spark.range(1).write.parquet(f"{tmp_path}/x.parquet")
    assert table(spark, str(tmp_path), "x").columns == ["id"]
    spark.range(1).withColumn("new", F.lit(1)).write.mode("overwrite").parquet(f"{tmp_path}/x.parquet")
    assert table(spark, str(tmp_path), "x").columns == ["id", "new"]


def test_partitioned_table_below_a_folder_with_a_space(spark, tmp_path):
    store = TableStore(spark, root=f"{tmp_path}/v=1/a b+c")
    store.write("t", spark.range(20).withColumn("p", F.col("id") % 2), partition_by=["p"])
    store.replace_partitions("t", spark.range(1).select("id", F.lit(1).cast("long").alias("p")), ["p=1"])
    assert store.read("t").count() == 11
