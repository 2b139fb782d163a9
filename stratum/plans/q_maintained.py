"""Queries for maintained aggregates (K3), touched-file merges (I1, I5) and kept
statistics (P6, G1, G2)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.operators import layout
from stratum.plans import fixtures
from stratum.plans.oracle import RAW_ORDERS, RAW_USERS, with_
from stratum.plans.project import Project
from stratum.plans.suite import register
from stratum.session import table

CUTS = ["2024-01-10 00:00:00", "2024-01-16 00:00:00"]


def _ts(s: str):
    return F.lit(s).cast("timestamp_ntz")


def _grown_events(spark, sf) -> Project:
    """Events that arrive in three runs, appended; users beside them, as loaded once."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), "ts")
    ends = [None, *map(_ts, CUTS), None]
    p = Project(spark, vars={"run": 0})

    def events():
        low, high = ends[p.var("run")], ends[p.var("run") + 1]
        rows = e if low is None else e.filter(F.col("ts") >= low)
        return rows if high is None else rows.filter(F.col("ts") < high)
    p.add_source("raw", {"events": events, "users": lambda: fixtures.raw_users(spark, sf)})
    p.model("events_all", lambda c: c.source("raw", "events"), materialized="incremental", incremental_strategy="append")
    p.model("users", lambda c: c.source("raw", "users"), materialized="materialized_view", enable_refresh=True, refresh_interval=dt.timedelta(days=1))
    return p


def _runs(p: Project, name: str, n: int) -> DataFrame:
    for run in range(n):
        p.vars["run"] = run
        out = p.run([name])[name]
    return out


@register("materialized_view_delta", with_(RAW_USERS) + """
SELECT event_type, coalesce(region, 'none') AS region, count(*) AS n_events, CAST(sum(cents) AS BIGINT) AS cents, min(ts) AS first_ts, max(ts) AS last_ts,
       CAST(sum(cents) AS DOUBLE) / count(cents) AS mean_cents
FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events) e LEFT JOIN raw_users u ON u.user_id = e.user_id
GROUP BY ALL""")
def materialized_view_delta(spark, sf):
    """K3: three refreshes of a mart over a growing table; the second and
    third read the appended folder only and merge its groups into the mart."""
    p = _grown_events(spark, sf)
    p.aggregate_view("event_mart", "events_all", ["event_type", "region"],
                     {"n_events": ("count",), "cents": ("sum", "cents"), "first_ts": ("min", "ts"), "last_ts": ("max", "ts"), "mean_cents": ("avg", "cents")},
                     rows=lambda ctx, e: e.join(ctx.ref("users").select("user_id", "region"), "user_id", "left").withColumn("region", F.coalesce("region", F.lit("none"))))
    return _runs(p, "event_mart", 3)


@register("materialized_view_retract", with_(RAW_ORDERS) + """,
m AS (SELECT order_id, user_id, amount_cents, status, created_at FROM raw_orders WHERE created_at < TIMESTAMP '1997-01-01'
      UNION ALL SELECT order_id, user_id, amount_cents + 100, 'complete', created_at FROM raw_orders WHERE created_at >= TIMESTAMP '1997-01-01')
SELECT status, CAST(year(created_at) AS INTEGER) AS year, count(*) AS n_orders, CAST(sum(amount_cents) AS BIGINT) AS cents,
       CAST(sum(amount_cents) AS DOUBLE) / count(amount_cents) AS mean_cents
FROM m GROUP BY ALL""")
def materialized_view_retract(spark, sf):
    """K3 over a table that is merged into: the second refresh takes back the
    rows of the files that the merge replaced, and adds those of the new ones."""
    o = fixtures.raw_orders(spark, sf)
    p = Project(spark, vars={"run": 0})
    changed = o.filter(F.col("created_at") >= _ts("1997-01-01")).select(
        "order_id", "user_id", (F.col("amount_cents") + 100).alias("amount_cents"), F.lit("complete").alias("status"), "created_at")
    p.add_source("raw", {"orders": lambda: changed if p.var("run") else o.filter(F.col("created_at") < _ts("1998-01-01"))})
    p.model("orders_all", lambda c: c.source("raw", "orders"), materialized="incremental", unique_key="order_id", cluster_by=["created_at"])
    p.aggregate_view("order_mart", "orders_all", ["status", "year"], {"n_orders": ("count",), "cents": ("sum", "amount_cents"), "mean_cents": ("avg", "amount_cents")},
                     rows=lambda ctx, rows: rows.withColumn("year", F.year("created_at")))
    return _runs(p, "order_mart", 2)


@register("merge_touched_files", with_(RAW_ORDERS) + """
SELECT order_id, user_id, CASE WHEN order_id BETWEEN 100 AND 400 THEN amount_cents + 7 ELSE amount_cents END AS amount_cents, status, created_at FROM raw_orders
UNION ALL SELECT -order_id, user_id, amount_cents + 7, status, created_at FROM raw_orders WHERE order_id BETWEEN 100 AND 120""")
def merge_touched_files(spark, sf):
    """I1 on an unpartitioned table clustered by its key: a change of a range
    of keys and some new ones rewrites only the files that hold the range."""
    from stratum.plans.increment import apply_increment
    o = fixtures.raw_orders(spark, sf)
    p = Project(spark)
    p.store.write("orders", o, cluster_by=["order_id"])
    inside = lambda high: o.filter(F.col("order_id").between(100, high)).withColumn("amount_cents", F.col("amount_cents") + 7)
    return apply_increment(p.store, "orders", inside(400).unionByName(inside(120).withColumn("order_id", -F.col("order_id"))), "merge", "order_id")


@register("high_water_observed", """
SELECT max(event_id) AS event_id, max(ts) AS ts, max(event_type) AS event_type, max(value) AS value, min(ts) AS first_ts, min(value) AS least_value FROM events""")
def high_water_observed(spark, sf):
    """P6 from the statistics that each append's write job took: no stored row is read for the bounds."""
    p = _grown_events(spark, sf)
    e = table(spark, sf, "events").select("event_id", "event_type", "value", "ts")
    p.store.write("events", e.filter(F.col("ts") < _ts(CUTS[0])))
    p.store.append_rows("events", e.filter(F.col("ts") >= _ts(CUTS[0])))
    high = [p.store.bound("events", c).alias(c) for c in ("event_id", "ts", "event_type", "value")]
    return spark.range(1).select(*high, p.store.bound("events", "ts", least=True).alias("first_ts"), p.store.bound("events", "value", least=True).alias("least_value"))


_BYTES = "CAST(sum(8 * 4 + strlen(status)) AS BIGINT)"


@register("table_stats_observed", with_(RAW_ORDERS) + f"""
SELECT 'by_year' AS table_name, CAST(date_trunc('year', created_at) AS DATE) AS _partition_time, count(*) AS num_rows, {_BYTES} AS num_bytes FROM raw_orders GROUP BY 2
UNION ALL SELECT 'orders', NULL, count(*), {_BYTES} FROM raw_orders
UNION ALL SELECT 'two columns', NULL, count(*), CAST(count(*) * 8 + sum(strlen(status)) AS BIGINT) FROM raw_orders""")
def table_stats_observed(spark, sf):
    """G1 and G2 from kept statistics: a table in two appends, a copy
    partitioned by year, and the bytes of two of its columns."""
    o = fixtures.raw_orders(spark, sf)
    store = Project(spark).store
    early = F.col("created_at") < _ts("1996-01-01")
    store.write("orders", o.filter(early))
    store.append_rows("orders", o.filter(~early))
    rows, parts = layout.apply_partitioning(o, layout.TimePartitioning("created_at", "YEAR"))
    store.write("by_year", rows, partition_by=parts)
    none = F.lit(None).cast("date").alias("_partition_time")
    whole = store.table_stats("orders").select("table_name", none, "num_rows", "num_bytes")
    two = whole.select(F.lit("two columns").alias("table_name"), "_partition_time", "num_rows", F.lit(store.scan_bytes("orders", ["order_id", "status"])).cast("long").alias("num_bytes"))
    return store.table_stats("by_year", per_partition=True).unionByName(whole).unionByName(two)
