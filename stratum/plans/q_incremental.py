"""Queries for the incremental strategies and incremental models
(I1-I8, K5, K6, S6, P6).

Target / source splits are time windows of the same table with an overlap:
T = rows before 1998, S = rows from 1997 on with changed values, so the
overlap year exercises the matched path and the later years the insert path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.operators import strategies as S
from stratum.plans import fixtures
from stratum.plans.oracle import RAW_ORDERS, with_
from stratum.plans.project import Project
from stratum.plans.suite import register
from stratum.session import table

T_END = "1998-01-01 00:00:00"
S_START = "1997-01-01 00:00:00"
EV_SPLIT = "2024-01-16 00:00:00"
EV_REPLAY = "2024-01-10 00:00:00"

SPLIT_SQL = f"""t AS (SELECT * FROM raw_orders WHERE created_at < TIMESTAMP '{T_END}'),
s AS (SELECT order_id, user_id, amount_cents + 100 AS amount_cents, 'complete' AS status,
             created_at FROM raw_orders WHERE created_at >= TIMESTAMP '{S_START}')"""


def _ts(s: str):
    return F.lit(s).cast("timestamp_ntz")


def _target(spark, sf) -> DataFrame:
    return fixtures.raw_orders(spark, sf).filter(F.col("created_at") < _ts(T_END))


def _source(spark, sf) -> DataFrame:
    o = fixtures.raw_orders(spark, sf).filter(F.col("created_at") >= _ts(S_START))
    return o.select("order_id", "user_id", (F.col("amount_cents") + 100).alias("amount_cents"),
                    F.lit("complete").alias("status"), "created_at")


@register("merge_upsert", with_(RAW_ORDERS, SPLIT_SQL) + """
SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.order_id = t.order_id)
UNION ALL SELECT * FROM s""")
def merge_upsert(spark, sf):
    return S.merge_upsert(_target(spark, sf), _source(spark, sf), "order_id")


LAST_SQL = f"""t AS (SELECT * FROM raw_orders WHERE created_at < TIMESTAMP '{T_END}'),
s AS (SELECT order_id, user_id, amount_cents + v AS amount_cents, 'v' || v AS status,
             created_at + INTERVAL 1 DAY * v AS created_at
      FROM raw_orders, (VALUES (1), (3), (2)) AS x(v) WHERE created_at >= TIMESTAMP '{S_START}')"""


@register("merge_last", with_(RAW_ORDERS, LAST_SQL) + """
SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.order_id = t.order_id)
UNION ALL SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY created_at DESC) = 1""")
def merge_last(spark, sf):
    """I1 with three rows per key in the increment of an incremental model:
    the latest by ``order_by`` is merged."""
    rows = [_target(spark, sf)]
    p = Project(spark)
    p.model("orders_latest", lambda ctx: rows[-1], materialized="incremental", unique_key="order_id",
            on_duplicate="last", order_by="created_at")
    p.run()
    o = fixtures.raw_orders(spark, sf).filter(F.col("created_at") >= _ts(S_START))
    v = F.explode(F.array(*[F.lit(i) for i in (1, 3, 2)])).alias("v")
    rows.append(o.select("*", v).select(
        "order_id", "user_id", (F.col("amount_cents") + F.col("v")).alias("amount_cents"),
        F.concat(F.lit("v"), F.col("v").cast("string")).alias("status"),
        (F.col("created_at") + F.make_dt_interval("v")).alias("created_at")))
    return p.run()["orders_latest"]


@register("incremental_new_column", with_(RAW_ORDERS, SPLIT_SQL) + """
SELECT t.*, CAST(NULL AS BIGINT) AS bonus FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.order_id = t.order_id)
UNION ALL SELECT s.*, CAST(user_id AS BIGINT) AS bonus FROM s""")
def incremental_new_column(spark, sf):
    """K5: a model gains a column; ``on_schema_change='append'`` adds it and old rows read NULL."""
    rows = [_target(spark, sf)]
    p = Project(spark)
    p.model("orders_wider", lambda ctx: rows[-1], materialized="incremental", unique_key="order_id",
            on_schema_change="append")
    p.run()
    rows.append(_source(spark, sf).withColumn("bonus", F.col("user_id").cast("long")))
    return p.run()["orders_wider"]


NULL_KEYS_SQL = f"""t AS (SELECT CASE WHEN order_id % 11 = 0 THEN NULL ELSE order_id END AS order_id,
             user_id, amount_cents, status, created_at
      FROM raw_orders WHERE created_at < TIMESTAMP '{T_END}'),
s AS (SELECT CASE WHEN order_id % 7 = 0 THEN NULL ELSE order_id END AS order_id,
             user_id, amount_cents + 100 AS amount_cents, 'complete' AS status, created_at
      FROM raw_orders WHERE created_at >= TIMESTAMP '{S_START}')"""


def _null_keys(df: DataFrame, m: int) -> DataFrame:
    return df.withColumn("order_id", F.when(F.col("order_id") % m == 0, F.lit(None))
                         .otherwise(F.col("order_id")))


@register("merge_null_keys", with_(RAW_ORDERS, NULL_KEYS_SQL) + """
SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.order_id = t.order_id)
UNION ALL SELECT * FROM s""")
def merge_null_keys(spark, sf):
    """I1 with NULL keys on both sides: NULL never matches, so NULL-key rows
    of T stay and NULL-key rows of S are inserted."""
    return S.merge_upsert(_null_keys(_target(spark, sf), 11), _null_keys(_source(spark, sf), 7),
                          "order_id")


@register("merge_keys_only", with_(RAW_ORDERS) + f""",
t AS (SELECT DISTINCT user_id, status FROM raw_orders WHERE created_at < TIMESTAMP '{T_END}'),
s AS (SELECT user_id, status FROM raw_orders WHERE created_at >= TIMESTAMP '{S_START}')
SELECT * FROM t
UNION ALL
SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.user_id = s.user_id
                                                   AND t.status = s.status)""")
def merge_keys_only(spark, sf):
    """Every column is a key, so nothing is updated; unmatched S rows
    (duplicates included) are inserted."""
    o = fixtures.raw_orders(spark, sf)
    t = o.filter(F.col("created_at") < _ts(T_END)).select("user_id", "status").distinct()
    s = o.filter(F.col("created_at") >= _ts(S_START)).select("user_id", "status")
    return S.merge_upsert(t, s, ["user_id", "status"])


@register("merge_insert_only", with_(RAW_ORDERS, SPLIT_SQL) + """
SELECT * FROM t
UNION ALL
SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.order_id = s.order_id)""")
def merge_insert_only(spark, sf):
    return S.merge_insert_only(_target(spark, sf), _source(spark, sf), "order_id")


LINE_AGG_SQL = f"""t AS (
  SELECT l_orderkey, l_linenumber, sum(l_quantity) AS qty, count(*) AS n_lines
  FROM lineitem WHERE l_shipdate < TIMESTAMP '{T_END}' GROUP BY 1, 2),
s AS (
  SELECT l_orderkey, l_linenumber, sum(l_quantity) + 1 AS qty, count(*) AS n_lines
  FROM lineitem WHERE l_shipdate >= TIMESTAMP '{S_START}' GROUP BY 1, 2)"""


@register("merge_composite", with_(LINE_AGG_SQL) + """
SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.l_orderkey = t.l_orderkey
                                                   AND s.l_linenumber = t.l_linenumber)
UNION ALL SELECT * FROM s""")
def merge_composite(spark, sf):
    """I4: merge on (l_orderkey, l_linenumber)."""
    k = ["l_orderkey", "l_linenumber"]
    li = S.by_key(table(spark, sf, "lineitem"), k)
    t = (li.filter(F.col("l_shipdate") < _ts(T_END)).groupBy(*k)
         .agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n_lines")))
    s = (li.filter(F.col("l_shipdate") >= _ts(S_START)).groupBy(*k)
         .agg((F.sum("l_quantity") + 1).alias("qty"), F.count(F.lit(1)).alias("n_lines")))
    return S.merge_upsert(t, s, k)


LINE_SPLIT_SQL = f"""t AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate
  FROM lineitem WHERE l_shipdate < TIMESTAMP '{T_END}'),
s AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + 1 AS l_quantity, l_shipdate
  FROM lineitem WHERE l_shipdate >= TIMESTAMP '{S_START}')"""


@register("delete_insert", with_(LINE_SPLIT_SQL) + """
SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.l_orderkey = t.l_orderkey
                                                   AND s.l_linenumber = t.l_linenumber)
UNION ALL SELECT * FROM s""")
def delete_insert(spark, sf):
    """(l_orderkey, l_linenumber) is not unique -- every S row survives."""
    li = table(spark, sf, "lineitem")
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate"]
    t = li.filter(F.col("l_shipdate") < _ts(T_END)).select(*cols)
    s = (li.filter(F.col("l_shipdate") >= _ts(S_START))
         .withColumn("l_quantity", F.col("l_quantity") + 1).select(*cols))
    return S.delete_insert(t, s, ["l_orderkey", "l_linenumber"])


@register("append", with_(RAW_ORDERS) + f"""
SELECT * FROM raw_orders WHERE created_at < TIMESTAMP '{T_END}'
UNION ALL
SELECT * FROM raw_orders WHERE created_at >= TIMESTAMP '{S_START}'""")
def append(spark, sf):
    """All S rows appended; the overlap year appears twice."""
    o = fixtures.raw_orders(spark, sf)
    return S.append(o.filter(F.col("created_at") < _ts(T_END)),
                    o.filter(F.col("created_at") >= _ts(S_START)))


@register("full_replace", with_(RAW_ORDERS, SPLIT_SQL) + "SELECT * FROM s")
def full_replace(spark, sf):
    """All rows of T replaced by S, T's schema kept."""
    return S.full_replace(_target(spark, sf), _source(spark, sf))


# --------------------------------------------------------------------------
# Incremental models over the versioned store (two real runs)


def _two_run_project(spark, sf, strategy: str) -> Project:
    p = Project(spark, vars={"run": 1})
    p.add_source("raw", {"orders": lambda: _target(spark, sf) if p.var("run") == 1
                         else _source(spark, sf)})
    p.model("fct_orders", lambda c: c.source("raw", "orders"), materialized="incremental",
            unique_key="order_id", incremental_strategy=strategy)
    return p


def _two_runs(p: Project, name: str) -> DataFrame:
    p.run([name])
    p.vars["run"] = 2
    return p.run([name])[name]


@register("mat_incremental", with_(RAW_ORDERS, SPLIT_SQL) + """
SELECT * FROM t WHERE order_id NOT IN (SELECT order_id FROM s)
UNION ALL SELECT * FROM s""")
def mat_incremental(spark, sf):
    """K5: first run builds the table, the second applies delete+insert."""
    return _two_runs(_two_run_project(spark, sf, "delete+insert"), "fct_orders")


@register("merge_two_runs", with_(RAW_ORDERS, SPLIT_SQL) + """
SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.order_id = t.order_id)
UNION ALL SELECT * FROM s""")
def merge_two_runs(spark, sf):
    """K5 with the default merge strategy, stored and read back."""
    return _two_runs(_two_run_project(spark, sf, "merge"), "fct_orders")


@register("replace_in_place", with_(RAW_ORDERS, SPLIT_SQL) + "SELECT * FROM s")
def replace_in_place(spark, sf):
    """K6: a table model rebuilt with ``full_replace``: rows replaced, the
    stored schema (and column comments) kept."""
    p = Project(spark, vars={"run": 1})
    p.add_source("raw", {"orders": lambda: _target(spark, sf) if p.var("run") == 1
                         else _source(spark, sf)})
    p.model("orders_tbl", lambda c: c.source("raw", "orders"), materialized="table",
            full_replace=True, column_comments={"amount_cents": "order amount in cents"})
    return _two_runs(p, "orders_tbl")


EVENTS_RUN_SQL = f""",
run1 AS (SELECT event_id, user_id, event_type, value, ts FROM events
         WHERE ts < TIMESTAMP '{EV_SPLIT}'),
run2 AS (SELECT event_id, user_id, event_type, value + 1 AS value, ts FROM events
         WHERE ts >= TIMESTAMP '{EV_REPLAY}'),
hw AS (SELECT * FROM run2 WHERE ts > (SELECT max(ts) FROM run1))"""


def _events_project(spark, sf) -> Project:
    p = Project(spark, vars={"run": 1})
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "ts")

    def events():
        if p.var("run") == 1:
            return e.filter(F.col("ts") < _ts(EV_SPLIT))
        return (e.filter(F.col("ts") >= _ts(EV_REPLAY))
                .withColumn("value", F.col("value") + 1))
    p.add_source("raw", {"events": events})

    @p.model("daily_events", materialized="incremental", unique_key="event_id")
    def daily_events(ctx):
        return ctx.high_water(ctx.source("raw", "events"), "ts")
    return p


@register("incremental_two_runs", "WITH x AS (SELECT 1)" + EVENTS_RUN_SQL + """
SELECT * FROM run1 WHERE NOT EXISTS (SELECT 1 FROM hw WHERE hw.event_id = run1.event_id)
UNION ALL SELECT * FROM hw""")
def incremental_two_runs(spark, sf):
    """I8: run 1 full; run 2 keeps only rows past the stored high water
    (P6) and merges them on event_id."""
    return _two_runs(_events_project(spark, sf), "daily_events")


@register("high_water_filter", "WITH x AS (SELECT 1)" + EVENTS_RUN_SQL + " SELECT * FROM hw")
def high_water_filter(spark, sf):
    """The second run's filtered model result."""
    p = _events_project(spark, sf)
    p.run(["daily_events"])
    p.vars["run"] = 2
    m = p.models["daily_events"]
    from stratum.plans.project import Context
    return m.build(Context(p, m, incremental=True))


@register("self_scan", with_(RAW_ORDERS) + """
SELECT user_id, CAST(sum(amount_cents) AS BIGINT) AS total_cents, count(*) AS n_orders
FROM raw_orders GROUP BY user_id""")
def self_scan(spark, sf):
    """An incremental aggregate that reads its own stored table.

    Run 1 sums orders before 1998; run 2 sums only the later orders and adds
    the stored totals of the touched users (``this``), then merges on
    user_id.  The result equals the full aggregate.
    """
    o = fixtures.raw_orders(spark, sf)
    p = Project(spark, vars={"run": 1})
    p.add_source("raw", {"orders": lambda: o.filter(F.col("created_at") < _ts(T_END))
                         if p.var("run") == 1 else o.filter(F.col("created_at") >= _ts(T_END))})

    @p.model("user_totals", materialized="incremental", unique_key="user_id")
    def user_totals(ctx):
        inc = ctx.source("raw", "orders").groupBy("user_id").agg(
            F.sum("amount_cents").alias("total_cents"), F.count(F.lit(1)).alias("n_orders"))
        if not ctx.is_incremental():
            return inc
        # Only the stored totals of touched users: the stored table is the
        # streamed side of a semi join against the increment's keys, then
        # the (small) result meets the increment.
        this = (ctx.this.join(inc.select("user_id"), "user_id", "left_semi")
                .select("user_id", F.col("total_cents").alias("old_total"),
                        F.col("n_orders").alias("old_n")))
        j = inc.join(this, "user_id", "left")
        return j.select("user_id",
                        (F.col("total_cents") + F.coalesce("old_total", F.lit(0))).alias("total_cents"),
                        (F.col("n_orders") + F.coalesce("old_n", F.lit(0))).alias("n_orders"))
    return _two_runs(p, "user_totals")


# --------------------------------------------------------------------------
# Partitioned incremental models: only touched partitions are rewritten

MOVED_SQL = f"""s AS (
  SELECT order_id, user_id, amount_cents + 100 AS amount_cents, 'complete' AS status,
         CASE WHEN amount_cents > 30000000 THEN created_at + INTERVAL 400 DAY
              ELSE created_at END AS created_at
  FROM raw_orders WHERE created_at >= TIMESTAMP '{S_START}'),
t AS (SELECT * FROM raw_orders WHERE created_at < TIMESTAMP '{T_END}')"""


def _moved_source(spark, sf) -> DataFrame:
    s = _source(spark, sf)
    from stratum.functions.helpers import dateadd
    return s.withColumn("created_at", F.when(F.col("amount_cents") > 30000000 + 100,
                                             dateadd("day", 400, "created_at"))
                        .otherwise(F.col("created_at")))


def _partitioned_project(spark, sf, strategy: str, source) -> Project:
    from stratum.operators.layout import TimePartitioning
    p = Project(spark, vars={"run": 1})
    p.add_source("raw", {"orders": lambda: _target(spark, sf) if p.var("run") == 1
                         else source(spark, sf)})
    p.model("fct_orders", lambda c: c.source("raw", "orders"), materialized="incremental",
            unique_key="order_id", incremental_strategy=strategy,
            partition_by=TimePartitioning("created_at", "MONTH"))
    return p


@register("merge_partitioned", with_(RAW_ORDERS, MOVED_SQL) + """,
m AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.order_id = t.order_id)
      UNION ALL SELECT * FROM s)
SELECT *, CAST(date_trunc('month', created_at) AS DATE) AS _partition_time FROM m""")
def merge_partitioned(spark, sf):
    """I1 on a month-partitioned table: the second run rewrites only the
    partitions holding increment rows or target rows with increment keys
    (some keys move to a later month)."""
    return _two_runs(_partitioned_project(spark, sf, "merge", _moved_source), "fct_orders")


@register("delete_insert_partitioned", with_(RAW_ORDERS, MOVED_SQL) + """,
m AS (SELECT * FROM t WHERE order_id NOT IN (SELECT order_id FROM s)
      UNION ALL SELECT * FROM s)
SELECT *, CAST(date_trunc('month', created_at) AS DATE) AS _partition_time FROM m""")
def delete_insert_partitioned(spark, sf):
    """I5 on a month-partitioned table."""
    return _two_runs(_partitioned_project(spark, sf, "delete+insert", _moved_source),
                     "fct_orders")


@register("append_partitioned", with_(RAW_ORDERS, SPLIT_SQL) + """,
m AS (SELECT * FROM t UNION ALL SELECT * FROM s)
SELECT *, CAST(date_trunc('month', created_at) AS DATE) AS _partition_time FROM m""")
def append_partitioned(spark, sf):
    """I6 on a month-partitioned table: new directories are added, nothing
    is rewritten."""
    return _two_runs(_partitioned_project(spark, sf, "append", _source), "fct_orders")


@register("high_water_partitioned", "WITH x AS (SELECT 1)" + EVENTS_RUN_SQL + """
SELECT *, CAST(ts AS DATE) AS _partition_time FROM (
  SELECT * FROM run1 WHERE NOT EXISTS (SELECT 1 FROM hw WHERE hw.event_id = run1.event_id)
  UNION ALL SELECT * FROM hw)""")
def high_water_partitioned(spark, sf):
    """P6 + I8 on a day-partitioned table: the stored maximum is read from
    the latest partition only, and the merge rewrites only touched days."""
    from stratum.operators.layout import TimePartitioning
    p = Project(spark, vars={"run": 1})
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "ts")

    def events():
        if p.var("run") == 1:
            return e.filter(F.col("ts") < _ts(EV_SPLIT))
        return (e.filter(F.col("ts") >= _ts(EV_REPLAY))
                .withColumn("value", F.col("value") + 1))
    p.add_source("raw", {"events": events})

    @p.model("daily_events", materialized="incremental", unique_key="event_id",
             partition_by=TimePartitioning("ts", "DAY"))
    def daily_events(ctx):
        return ctx.high_water(ctx.source("raw", "events"), "ts")
    return _two_runs(p, "daily_events")
