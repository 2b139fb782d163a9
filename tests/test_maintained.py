"""Maintained aggregates: what a refresh reads, and when it builds the view whole."""

import random

import pytest
from pyspark.sql import functions as F

from stratum.operators.maintain import Measure, MergeableAggregate
from stratum.plans.project import Project, ProjectError
from stratum.plans.store import TableStore
from stratum.types import Field

MEASURES = {"n": ("count",), "some": ("count", "v"), "total": ("sum", "v"), "mean": ("avg", "v")}
BOUNDS = {"low": ("min", "v"), "high": ("max", "v")}


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, v long").coalesce(1)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def project(spark, strategy, measures, **config):
    p = Project(spark, vars={"rows": []})
    p.model("base", lambda c: frame(spark, c.var("rows")), materialized="incremental", unique_key="id", incremental_strategy=strategy, **config)
    p.aggregate_view("mart", "base", ["g"], measures, rows=lambda ctx, df: df.filter("v IS NULL OR v < 1000"))
    return p


def whole(p, measures):
    a = MergeableAggregate(["g"], measures)
    return rows_of(a.finished(a.state(p.store.read("base").filter("v IS NULL OR v < 1000"))).select(*a.columns))


def refreshed(p, rows, monkeypatch):
    """The mart after another run, and the entries of ``base`` that were read for it."""
    read = []
    plain = TableStore.read_entries
    with monkeypatch.context() as m:
        m.setattr(TableStore, "read_entries", lambda self, name, info, entries, file_col=None: (read.extend(e.path for e in entries if name == "base" and not file_col), plain(self, name, info, entries, file_col))[1])
        p.vars["rows"] = rows
        p.run(["base"])
        read.clear()
        out = p.run(["mart"], fresh=False)["mart"]
    return rows_of(out), read


def test_appends_are_merged_and_nothing_else_is_read(spark, monkeypatch):
    measures = MEASURES | BOUNDS
    p = project(spark, "append", measures)
    refreshed(p, [(1, "a", 5), (2, "a", None), (3, None, 7), (4, "b", None), (5, "b", 2000)], monkeypatch)
    first = {e.path for e in p.store.entries("base")}
    got, read = refreshed(p, [(6, "b", 3), (7, "c", -1), (8, None, 9), (9, "a", None)], monkeypatch)
    assert got == whole(p, measures) and len(got) == 4
    versions = p.store.info("base")["version"]
    assert versions == 2 and [e.path for e in p.store.entries("base") if e.path not in first]
    now = p.store.info("mart")["version"]
    p.vars["rows"] = []
    p._built = {"base": p.store.read("base")}   # nothing new upstream
    assert rows_of(p.run(["mart"], fresh=False)["mart"]) == got and p.store.info("mart")["version"] == now


def test_a_refresh_reads_only_new_folders(spark, monkeypatch):
    p = project(spark, "append", MEASURES)
    refreshed(p, [(i, "a", i) for i in range(10)], monkeypatch)
    refreshed(p, [(20, "a", 1)], monkeypatch)
    old = {e.path for e in p.store.entries("base")}
    p.vars["rows"] = [(21, "b", 1)]
    p.run(["base"])
    read = []
    plain = TableStore.read_entries
    monkeypatch.setattr(TableStore, "read_entries", lambda self, name, info, entries, file_col=None: (read.append((name, [e.path for e in entries])), plain(self, name, info, entries, file_col))[1])
    gained, lost = p._changes("base", p.store.info("base")["version"] - 1)
    assert len(gained) == 1 and not lost and gained[0].path not in old
    p._built["base"] = p.store.read("base")
    read.clear()
    assert rows_of(p.run(["mart"], fresh=False)["mart"]) == whole(p, MEASURES)
    parts = [paths for name, paths in read if name == "base" and len(paths) < 3]
    assert parts and all(paths == [gained[0].path] for paths in parts)


@pytest.mark.parametrize("strategy", ["merge", "delete+insert"])
def test_random_changes_equal_the_whole_query(spark, monkeypatch, strategy):
    rng = random.Random(len(strategy))
    p = project(spark, strategy, MEASURES)
    row = lambda i: (i, rng.choice(["a", "b", None]), rng.choice([None, 1, 5, 2000, -3]))
    refreshed(p, [row(i) for i in range(20)], monkeypatch)
    for _ in range(3):
        got, _ = refreshed(p, [row(i) for i in rng.sample(range(30), 5)], monkeypatch)
        assert got == whole(p, MEASURES)


def test_bounds_cannot_be_taken_back(spark, monkeypatch):
    p = project(spark, "merge", MEASURES | BOUNDS)
    refreshed(p, [(1, "a", 9), (2, "a", 1)], monkeypatch)
    got, _ = refreshed(p, [(1, "a", 2)], monkeypatch)
    assert got == whole(p, MEASURES | BOUNDS)   # built whole
    a = MergeableAggregate(["g"], BOUNDS)
    with pytest.raises(ValueError, match="taken back"):
        a.negated(a.state(p.store.read("base")))


def test_changes_that_need_the_whole_view(spark, monkeypatch):
    p = project(spark, "append", MEASURES)
    refreshed(p, [(1, "a", 9)], monkeypatch)
    p.store.evolve("base", [Field("w", "INT64", alter="insert")])
    p._built = {"base": p.store.read("base")}
    assert rows_of(p.run(["mart"], fresh=False)["mart"]) == whole(p, MEASURES)
    dims = Project(spark, vars={"rows": [(1, "a", 1)], "name": "x"})
    dims.model("base", lambda c: frame(spark, c.var("rows")), materialized="incremental", unique_key="id", incremental_strategy="append")
    dims.model("names", lambda c: spark.createDataFrame([("a", c.var("name"))], "g string, name string"), materialized="table")
    dims.aggregate_view("mart", "base", ["name"], {"n": ("count",)}, rows=lambda ctx, df: df.join(ctx.ref("names"), "g"))
    dims.run(["mart"])
    dims.vars.update(name="y", rows=[(2, "a", 1)])
    assert rows_of(dims.run(["mart"])["mart"]) == [("y", 2)]   # a changed dimension: all rows again


def test_declarations(spark):
    p = Project(spark)
    p.model("v", lambda c: frame(spark, []), materialized="view")
    p.aggregate_view("mart", "v", ["g"], {"n": ("count",)})
    with pytest.raises(ProjectError, match="stored"):
        p.run(["mart"])
    for bad in ({"g": ("count",)}, {"__x": ("count",)}, {"x": ("median", "v")}, {"x": ("sum",)}):
        with pytest.raises(ValueError):
            MergeableAggregate(["g"], bad)
    with pytest.raises(ProjectError, match="without partitions"):
        p.aggregate_view("m2", "v", ["g"], {"n": ("count",)}, materialized="table")
    assert Measure("count").value is None
