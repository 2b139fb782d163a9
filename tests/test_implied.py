"""Bounds that predicates imply, and which folders a scan reads for them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratum.operators import implied, layout
from stratum.operators.layout import PartitionFilterRequired
from stratum.plans.store import TableStore

D = dt.datetime


@pytest.fixture(scope="module")
def rows(spark):
    return spark.sql("""SELECT id, CAST(id % 7 AS INT) AS k, TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id AS INT), 6) AS t,
        IF(id = 3, NULL, concat('v', id)) AS s, CAST(id AS DOUBLE) / 3 AS x FROM range(100)""").coalesce(1)


@pytest.mark.parametrize("predicate,want", [
    ("t >= '2024-01-05' AND t < '2024-02-01'", {"t": (D(2024, 1, 5), D(2024, 2, 1))}),
    ("CAST(t AS DATE) >= DATE'2024-03-01'", {"t": (D(2024, 3, 1), None)}),
    ("NOT (id < 5) AND id IN (7, 9, 8)", {"id": (7, 9)}),
    ("id = 4 OR k = 2", {}),
    ("(id = 4 OR k = 2) AND x <= 1.5", {"x": (None, 1.5)}),
    ("s LIKE 'v1%'", {"s": ("v1", None)}),
    ("id = 3 AND year(t) = 2024", {"id": (3, 3)}),
])
def test_bounds(spark, rows, predicate, want):
    found = implied.bounds(spark, rows.schema, predicate)
    assert {c: (b.low, b.high) for c, b in found.items()} == want
    assert implied.bounds(spark, rows.schema, F.expr(predicate)).keys() == want.keys()
    assert implied.bounds(spark, rows.schema, "s IS NULL")["s"].null
    assert spark.conf.get(implied.PUSHDOWN, "false") == "false"


PREDICATES = ["t >= '2024-01-05' AND t < '2024-02-01'", "t = '2024-01-11 06:00:00'", "t > '2030-01-01'", "t IS NULL", "id BETWEEN 10 AND 12 AND t >= '2024-01-01'",
              "t >= '2024-02-10' AND (k = 1 OR s = 'v60')", "t < '2024-01-03' AND s IS NULL"]


@pytest.mark.parametrize("granularity", ["HOUR", "DAY", "MONTH", "YEAR"])
def test_scan_of_partitions_equals_a_filter(spark, rows, granularity, monkeypatch):
    spec = layout.TimePartitioning("t", granularity)
    some = rows.filter("id % 9 < 3").withColumn("t", F.when(F.col("id") != 20, F.col("t")))
    parted, cols = layout.apply_partitioning(some, spec)
    store = TableStore(spark)
    store.write("p", parted, partition_by=cols, require_partition_filter=True, extra=layout.described(spec))
    read = []
    plain = TableStore.read_entries
    monkeypatch.setattr(TableStore, "read_entries", lambda self, name, info, entries, file_col=None: (read.append(len(entries)), plain(self, name, info, entries, file_col))[1])
    for p in PREDICATES:
        read.clear()
        got = sorted(r["id"] for r in store.scan("p", p).collect())
        assert got == sorted(r["id"] for r in some.filter(p).collect()), p
        if granularity == "DAY":
            assert read[-1] < read[0]
    for p in ("id = 4", "k = 1 OR t > '2024-01-01'", None):
        with pytest.raises(PartitionFilterRequired):
            store.scan("p", p)
    assert store.scan("p", F.col(cols[0]).isNotNull()).count() == some.filter("t IS NOT NULL").count()


def test_folders_are_skipped_by_statistics_of_any_column(spark, rows):
    store = TableStore(spark)
    store.write("u", rows.filter("id < 30"))
    store.append_rows("u", rows.filter("id >= 30 AND id < 60"))
    store.append_rows("u", rows.filter("id >= 60"))
    for p, files in (("id = 45", 1), ("x > 50", 0), ("x >= 10 AND x < 15", 1), ("s IS NULL", 1), ("t < '2024-02-05'", 2), ("k = 3", 3), ("s = 'zzz'", 0)):
        df = store.scan("u", p)
        assert len(df.inputFiles()) == files and sorted(r["id"] for r in df.collect()) == sorted(r["id"] for r in rows.filter(p).collect()), p


def test_range_partitions_and_time_zones(spark, rows):
    spec = layout.RangePartitioning("id", 10, 50, 10)
    parted, cols = layout.apply_partitioning(rows, spec)
    store = TableStore(spark)
    store.write("r", parted, partition_by=cols, extra=layout.described(spec))
    for p in ("id >= 25 AND id < 41", "id = 3", "id > 70", "id BETWEEN 5 AND 15"):
        df = store.scan("r", p)
        assert sorted(r["id"] for r in df.collect()) == sorted(r["id"] for r in rows.filter(p).collect()), p
    assert len(store.scan("r", "id >= 25 AND id < 30").inputFiles()) == 3   # its own, its neighbour (bounds count as included), values out of range
    zoned = rows.withColumn("t", F.col("t").cast("timestamp"))
    spec = layout.TimePartitioning("t", "DAY")
    parted, cols = layout.apply_partitioning(zoned, spec)
    store.write("z", parted, partition_by=cols, extra=layout.described(spec))
    df = store.scan("z", "t >= TIMESTAMP'2024-01-10 22:00:00-05:00' AND t < TIMESTAMP'2024-01-13 00:00:00'")
    assert sorted(r["id"] for r in df.collect()) == [10, 11] and len(df.inputFiles()) <= 3
