"""Queries for table layout, retention, statistics and cost (K7-K10, K14,
P7, G1, G2)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stratum.operators import layout, stats
from stratum.plans import fixtures
from stratum.plans.oracle import RAW_ORDERS, with_
from stratum.plans.project import Project
from stratum.plans.suite import register
from stratum.session import table

ORDERS = with_(RAW_ORDERS)
AS_OF = dt.datetime(2001, 9, 1)


def _orders_model(spark, sf, **config) -> Project:
    p = Project(spark)
    p.add_source("raw", {"orders": lambda: fixtures.raw_orders(spark, sf)})
    p.model("fct_orders", lambda c: c.source("raw", "orders"), **config)
    return p


@register("time_partition", ORDERS + """
SELECT *, CAST(date_trunc('month', created_at) AS DATE) AS _partition_time FROM raw_orders""")
def time_partition(spark, sf):
    """K7: partitioned by the month of created_at; read back from the files."""
    p = _orders_model(spark, sf, materialized="table",
                      partition_by=layout.TimePartitioning("created_at", "MONTH"))
    return p.run(["fct_orders"])["fct_orders"]


@register("ingest_time_partition", ORDERS + """
SELECT *, DATE '2024-02-01' AS _partition_ingest FROM raw_orders""")
def ingest_time_partition(spark, sf):
    """K8: no partition field -- partitioned by the (fixed) load time."""
    p = _orders_model(spark, sf, materialized="table",
                      partition_by=layout.TimePartitioning(None, "DAY"))
    return p.run(["fct_orders"], run_ts=dt.datetime(2024, 2, 1, 6, 0, 0))["fct_orders"]


@register("range_partition", """
SELECT p_partkey, p_name, p_size,
       CASE WHEN p_size IS NULL THEN NULL
            WHEN p_size < 0 OR p_size >= 40 THEN -9223372036854775808
            ELSE CAST(floor(p_size / 10) * 10 AS BIGINT) END AS _partition_range
FROM part""")
def range_partition(spark, sf):
    """K9: integer ranges [0,40) by 10 on p_size; larger sizes share the
    out-of-range partition."""
    p = Project(spark)
    p.add_source("raw", {"part": lambda: table(spark, sf, "part")
                         .select("p_partkey", "p_name", "p_size")})
    p.model("parts", lambda c: c.source("raw", "part"), materialized="table",
            partition_by=layout.RangePartitioning("p_size", 0, 40, 10))
    return p.run(["parts"])["parts"]


@register("cluster_by", ORDERS + "SELECT * FROM raw_orders")
def cluster_by(spark, sf):
    """Rows grouped by (user_id, created_at) and files sorted by them."""
    p = _orders_model(spark, sf, materialized="table", cluster_by=["user_id", "created_at"])
    return p.run(["fct_orders"])["fct_orders"]


@register("retention", ORDERS + """
SELECT *, CAST(date_trunc('month', created_at) AS DATE) AS _partition_time FROM raw_orders
WHERE CAST(date_trunc('month', created_at) AS DATE) >= DATE '1998-09-02'""")
def retention(spark, sf):
    """Month partitions older than 1095 days at 2001-09-01 expire."""
    p = _orders_model(spark, sf, materialized="table",
                      partition_by=layout.TimePartitioning("created_at", "MONTH"))
    p.run(["fct_orders"])
    return p.store.expire_partitions("fct_orders", 1095, AS_OF)


@register("retention_sweep", ORDERS + """
SELECT DISTINCT strftime(date_trunc('month', created_at), '_partition_time=%Y-%m-%d') AS part, created_at < TIMESTAMP '1998-10-01' AS expired
FROM raw_orders WHERE created_at < TIMESTAMP '1998-10-01' OR (created_at >= TIMESTAMP '1999-03-01' AND created_at < TIMESTAMP '1999-05-01')""")
def retention_sweep(spark, sf):
    """The dry run of a sweep.  Months expired and, of those kept, the two
    that a later run rewrote are files that no readable version holds."""
    p = _orders_model(spark, sf, materialized="table",
                      partition_by=layout.TimePartitioning("created_at", "MONTH"))
    store = p.store
    store.keep_versions = 1
    p.run(["fct_orders"])
    store.expire_partitions("fct_orders", 1095, AS_OF)
    parts = ["_partition_time=1999-03-01", "_partition_time=1999-04-01"]
    store.replace_partitions("fct_orders", store.read_partitions("fct_orders", parts), parts)
    found = store.unreachable_files("fct_orders", older_than=dt.timedelta(0))
    return found.select("part", (F.col("part") < "_partition_time=1998-10").alias("expired")).distinct()


@register("cluster_overlaps", ORDERS + """
SELECT order_id, user_id, amount_cents, status, created_at, true AS bounded FROM raw_orders""")
def cluster_overlaps(spark, sf):
    """Ten appends that each span all keys, put together as they come;
    ``bounded`` says that no more than five folders overlap in the end."""
    o = fixtures.raw_orders(spark, sf)
    store = Project(spark).store
    part = lambda i: o.filter(F.pmod(F.xxhash64("order_id"), F.lit(10)) == i)
    store.write("orders", part(0), cluster_by=["order_id"])
    for i in range(1, 10):
        store.append_rows("orders", part(i))
        store.recluster("orders")
    return store.read("orders").withColumn("bounded", F.lit(len(store.entries("orders")) <= 5))


@register("required_partition_filter", ORDERS + """
SELECT *, CAST(date_trunc('month', created_at) AS DATE) AS _partition_time FROM raw_orders
WHERE CAST(date_trunc('month', created_at) AS DATE) >= DATE '2000-01-01'""")
def required_partition_filter(spark, sf):
    """A flagged table read with the mandatory partition predicate."""
    p = _orders_model(spark, sf, materialized="table", require_partition_filter=True,
                      partition_by=layout.TimePartitioning("created_at", "MONTH"))
    p.run(["fct_orders"])
    return p.store.scan("fct_orders", F.col("_partition_time") >= F.lit("2000-01-01").cast("date"))


@register("implied_partition_filter", ORDERS + """
SELECT order_id, user_id, amount_cents, status, created_at, CAST(date_trunc('month', created_at) AS DATE) AS _partition_time, 'text' AS filter
FROM raw_orders WHERE created_at >= TIMESTAMP '1996-02-10' AND created_at < TIMESTAMP '1996-05-03 12:00:00' AND amount_cents > 1000000
UNION ALL
SELECT order_id, user_id, amount_cents, status, created_at, CAST(date_trunc('month', created_at) AS DATE), 'column'
FROM raw_orders WHERE created_at BETWEEN TIMESTAMP '1997-12-24' AND TIMESTAMP '1998-01-06' AND (status = 'open' OR user_id % 2 = 0)""")
def implied_partition_filter(spark, sf):
    """A flagged model referenced with filters on the field that it is
    partitioned by; only the months that can hold such rows are read."""
    p = _orders_model(spark, sf, materialized="table", require_partition_filter=True,
                      partition_by=layout.TimePartitioning("created_at", "MONTH"))
    p.model("spring", lambda c: c.ref("fct_orders", "created_at >= '1996-02-10' AND created_at < '1996-05-03 12:00:00' AND amount_cents > 1000000")
            .withColumn("filter", F.lit("text")), materialized="ephemeral")
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    p.model("holidays", lambda c: c.ref("fct_orders", F.col("created_at").between(day("1997-12-24"), day("1998-01-06")) & ((F.col("status") == "open") | (F.col("user_id") % 2 == 0)))
            .withColumn("filter", F.lit("column")), materialized="ephemeral")
    p.model("both", lambda c: c.ref("spring").unionByName(c.ref("holidays")), materialized="ephemeral")
    return p.run(["both"])["both"]


def _bytes(fixed: list[str], texts: list[str]) -> str:
    """SQL for the logical bytes of all rows: 8 for each number or time, UTF-8 bytes for each text."""
    one = [f"CASE WHEN {c} IS NULL THEN 0 ELSE 8 END" for c in fixed] + [f"coalesce(strlen({c}), 0)" for c in texts]
    return f"CAST(coalesce(sum({' + '.join(one)}), 0) AS BIGINT)"


_ORDERS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"]
_LINES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax", "l_shipdate"]
_CUSTOMERS = ["c_custkey", "c_nationkey", "c_acctbal"]


@register("table_stats", ORDERS + f"""
SELECT 'fct_orders' AS table_name, CAST(date_trunc('year', created_at) AS DATE) AS _partition_time,
       count(*) AS num_rows, {_bytes(["order_id", "user_id", "amount_cents", "created_at"], ["status"])} AS num_bytes
FROM raw_orders GROUP BY 2
UNION ALL SELECT 'orders', NULL, count(*), {_bytes(_ORDERS, ["o_orderstatus", "o_orderpriority"])} FROM orders
UNION ALL SELECT 'lineitem', NULL, count(*), {_bytes(_LINES, ["l_returnflag", "l_linestatus"])} FROM lineitem
UNION ALL SELECT 'customer', NULL, count(*), {_bytes(_CUSTOMERS, ["c_name", "c_mktsegment"])} FROM customer""")
def table_stats(spark, sf):
    """G1: rows and logical bytes per table and, for a year-partitioned copy
    of orders, per partition."""
    p = _orders_model(spark, sf, materialized="table",
                      partition_by=layout.TimePartitioning("created_at", "YEAR"))
    stored = p.run(["fct_orders"])["fct_orders"]
    whole = [stats.table_stats(n, table(spark, sf, n)).withColumn("_partition_time",
                                                                  F.lit(None).cast("date"))
             for n in ("orders", "lineitem", "customer")]
    out = stats.table_stats("fct_orders", stored, ["_partition_time"])
    for w in whole:
        out = out.unionByName(w)
    return out


@register("scan_cost", f"""
WITH used AS (
  SELECT 'orders' AS input_table, {_bytes(_ORDERS, ["o_orderstatus"])} AS estimated_bytes FROM orders
  UNION ALL SELECT 'customer', {_bytes(_CUSTOMERS, ["c_name"])} FROM customer
  UNION ALL SELECT 'nation', {_bytes(["n_nationkey", "n_regionkey"], [])} FROM nation
  UNION ALL SELECT 'region', {_bytes(["r_regionkey"], ["r_name"])} FROM region)
SELECT 'mart_revenue' AS model, input_table, estimated_bytes,
       CASE WHEN estimated_bytes / {stats.GIB} < 0.01
            THEN printf('~$%.4f (%.1f MB)', estimated_bytes / {stats.TIB} * {stats.PRICE_PER_TIB}, estimated_bytes / {stats.MIB})
            ELSE printf('~$%.2f (%.1f GB)', estimated_bytes / {stats.TIB} * {stats.PRICE_PER_TIB}, estimated_bytes / {stats.GIB})
       END AS estimated_cost
FROM used""")
def scan_cost(spark, sf):
    """Logical bytes and price of the columns that the revenue mart uses."""
    return stats.scan_estimate("mart_revenue", [
        ("orders", table(spark, sf, "orders"),
         ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate"]),
        ("customer", table(spark, sf, "customer"), ["c_custkey", "c_name", "c_acctbal",
                                                    "c_nationkey"]),
        ("nation", table(spark, sf, "nation"), ["n_nationkey", "n_regionkey"]),
        ("region", table(spark, sf, "region"), ["r_regionkey", "r_name"]),
    ])
