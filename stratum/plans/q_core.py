"""Queries for scans, materializations, row operators, joins, aggregates and
helper functions (S1, S2, S4, K1-K4, P1-P5, P8, P9, P11, P12, J1, J2, J5,
A1-A8, U1, F1-F11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions import helpers as H
from stratum.functions.macros import Macros
from stratum.operators import predicates
from stratum.plans import fixtures
from stratum.plans.marts import revenue_by_region_month, revenue_project
from stratum.plans.oracle import RAW_EVENTS, RAW_ORDERS, RAW_USERS, STAGING, with_
from stratum.plans.project import Project
from stratum.plans.suite import register
from stratum.session import table

FIXED_RUN_TS = "2024-02-01 00:00:00"

# --------------------------------------------------------------------------
# The flagship mart


def mart_revenue(spark: SparkSession, sf: str) -> DataFrame:
    return revenue_project(spark, sf).run(["mart_revenue"])["mart_revenue"]


MART_SQL = with_(RAW_ORDERS, RAW_USERS, STAGING) + """
SELECT region, date_trunc('month', created_at) AS month,
       count(DISTINCT user_id) AS unique_buyers,
       CAST(sum(CAST(amount_dollars AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue,
       CAST(sum(CAST(amount_dollars AS DECIMAL(18,2))) AS DOUBLE)
         / nullif(count(DISTINCT user_id), 0) AS revenue_per_buyer
FROM int_joined GROUP BY 1, 2"""

register("mart_revenue", MART_SQL)(mart_revenue)
register("mat_table", MART_SQL)(mart_revenue)


@register("agg_ratio", with_(RAW_ORDERS) + """
SELECT status, CAST(sum(amount_cents) AS BIGINT) AS total_cents,
       count(DISTINCT user_id) AS buyers,
       CAST(sum(amount_cents) AS BIGINT) / nullif(count(DISTINCT user_id), 0) AS cents_per_buyer
FROM raw_orders GROUP BY status""")
def agg_ratio(spark, sf):
    o = fixtures.raw_orders(spark, sf)
    total = F.sum("amount_cents")
    buyers = F.count_distinct("user_id")
    return o.groupBy("status").agg(total.alias("total_cents"), buyers.alias("buyers"),
                                   H.safe_divide(total, buyers).alias("cents_per_buyer"))


# --------------------------------------------------------------------------
# Scans and materializations


@register("source_scan", with_(RAW_ORDERS) + "SELECT * FROM raw_orders")
def source_scan(spark, sf):
    p = Project(spark)
    p.add_source("raw", {"orders": lambda: fixtures.raw_orders(spark, sf)})
    return p.source("raw", "orders")


@register("ref_scan", with_(RAW_ORDERS, RAW_USERS, STAGING) + "SELECT * FROM int_enriched")
def ref_scan(spark, sf):
    return revenue_project(spark, sf).run(["int_enriched"])["int_enriched"]


@register("mat_view", with_(RAW_ORDERS, RAW_USERS, STAGING) + "SELECT * FROM stg_users")
def mat_view(spark, sf):
    return revenue_project(spark, sf).run(["stg_users"])["stg_users"]


@register("join_inner", with_(RAW_ORDERS, RAW_USERS, STAGING) + "SELECT * FROM int_joined")
def join_inner(spark, sf):
    return revenue_project(spark, sf).run(["int_joined"])["int_joined"]


@register("mat_ephemeral", with_(RAW_EVENTS) + """,
e1 AS (SELECT event_id, user_id, amount_cents, event_ts FROM raw_events),
e2 AS (SELECT *, CAST(amount_cents AS DOUBLE) / 100.0 AS amount_dollars FROM e1),
e3 AS (SELECT *, date_trunc('day', event_ts) AS event_day FROM e2),
e4 AS (SELECT * FROM e3 WHERE amount_cents > 500),
e5 AS (SELECT event_id, user_id, amount_dollars, event_day FROM e4)
SELECT * FROM e5""")
def mat_ephemeral(spark, sf):
    """K4: a five-level chain of ephemeral models, inlined into one plan."""
    p = Project(spark)
    p.add_source("raw", {"events": lambda: fixtures.raw_events(spark, sf)})
    p.model("e1", lambda c: c.source("raw", "events")
            .select("event_id", "user_id", "amount_cents", "event_ts"), materialized="ephemeral")
    p.model("e2", lambda c: c.ref("e1").withColumn("amount_dollars",
                                                   H.cents_to_dollars("amount_cents")),
            materialized="ephemeral")
    p.model("e3", lambda c: c.ref("e2").withColumn("event_day",
                                                   H.month_start("event_ts", "day")),
            materialized="ephemeral")
    p.model("e4", lambda c: c.ref("e3").filter(F.col("amount_cents") > 500),
            materialized="ephemeral")
    p.model("e5", lambda c: c.ref("e4").select("event_id", "user_id", "amount_dollars",
                                               "event_day"), materialized="ephemeral")
    return p.run(["e5"])["e5"]


@register("union_all", with_(RAW_EVENTS) + """,
base AS (SELECT event_id, user_id, event_type, amount_cents FROM raw_events),
clicks AS (SELECT * FROM base WHERE event_type = 'click'),
big AS (SELECT * FROM base WHERE amount_cents >= 1000)
SELECT * FROM clicks UNION ALL SELECT * FROM big""")
def union_all(spark, sf):
    """U1 + K4 diamond: two refs of one shared ephemeral upstream, UNION ALL."""
    p = Project(spark)
    p.add_source("raw", {"events": lambda: fixtures.raw_events(spark, sf)})
    p.model("base", lambda c: c.source("raw", "events")
            .select("event_id", "user_id", "event_type", "amount_cents"), materialized="ephemeral")
    p.model("clicks", lambda c: c.ref("base").filter(F.col("event_type") == "click"),
            materialized="ephemeral")
    p.model("big", lambda c: c.ref("base").filter(F.col("amount_cents") >= 1000),
            materialized="ephemeral")
    p.model("both", lambda c: c.ref("clicks").unionByName(c.ref("big")),
            materialized="ephemeral")
    return p.run(["both"])["both"]


@register("inline_rows", with_(RAW_EVENTS) + """
SELECT r.event_id, r.user_id, r.event_name, r.event_ts FROM (
  SELECT unnest([
    {'event_id': event_id, 'user_id': 'u' || CAST(user_id AS VARCHAR),
     'event_name': event_type, 'event_ts': event_ts},
    {'event_id': event_id + 1000000000, 'user_id': 'u' || CAST(user_id AS VARCHAR),
     'event_name': 'echo', 'event_ts': event_ts + INTERVAL 1 HOUR}]) AS r
  FROM raw_events)""")
def inline_rows(spark, sf):
    """Rows from an inline array of structs, one array per input row."""
    e = fixtures.raw_events(spark, sf)
    uid = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return e.select(F.inline(F.array(
        F.struct(F.col("event_id").alias("event_id"), uid.alias("user_id"),
                 F.col("event_type").alias("event_name"), F.col("event_ts").alias("event_ts")),
        F.struct((F.col("event_id") + 1000000000).alias("event_id"), uid.alias("user_id"),
                 F.lit("echo").alias("event_name"),
                 H.dateadd("hour", 1, "event_ts").alias("event_ts")))))


# --------------------------------------------------------------------------
# Projections and filters


@register("project_alias", with_(RAW_USERS) + """
SELECT user_id AS customer_id, email AS full_email, region,
       created_at AS customer_created_at FROM raw_users""")
def project_alias(spark, sf):
    u = fixtures.raw_users(spark, sf)
    return u.select(F.col("user_id").alias("customer_id"), F.col("email").alias("full_email"),
                    "region", F.col("created_at").alias("customer_created_at"))


@register("computed_column", with_(RAW_ORDERS) + """
SELECT order_id, CAST(amount_cents AS DOUBLE) / 100.0 AS amount_dollars,
       round(amount_cents / 100, 2) AS amount_dollars_rounded FROM raw_orders""")
def computed_column(spark, sf):
    m = Macros().define("cents_to_dollars", H.cents_to_dollars)
    o = fixtures.raw_orders(spark, sf)
    return o.select("order_id", m("cents_to_dollars", "amount_cents").alias("amount_dollars"),
                    m("cents_to_dollars", "amount_cents", True).alias("amount_dollars_rounded"))


NULLABLE_STATUS = """orders_ns AS (
  SELECT order_id, user_id, amount_cents,
         CASE WHEN order_id % 13 = 0 THEN NULL ELSE status END AS status, created_at
  FROM raw_orders)"""


def _orders_nullable_status(spark, sf):
    o = fixtures.raw_orders(spark, sf)
    return o.withColumn("status", F.when(F.col("order_id") % 13 == 0, F.lit(None))
                        .otherwise(F.col("status")))


@register("filter_neq", with_(RAW_ORDERS, NULLABLE_STATUS) +
          "SELECT * FROM orders_ns WHERE status != 'cancelled'")
def filter_neq(spark, sf):
    """``!=`` drops NULL status rows too (the predicate is NULL there)."""
    return _orders_nullable_status(spark, sf).filter(F.col("status") != "cancelled")


@register("filter_eq", with_(RAW_EVENTS) + """
SELECT event_ts AS order_ts, user_id, amount_cents, region
FROM raw_events WHERE event_type = 'purchase'""")
def filter_eq(spark, sf):
    e = fixtures.raw_events(spark, sf)
    return (e.filter(F.col("event_type") == "purchase")
            .select(F.col("event_ts").alias("order_ts"), "user_id", "amount_cents", "region"))


@register("filter_not_null", with_(RAW_USERS) +
          "SELECT user_id, email, region, created_at FROM raw_users WHERE email IS NOT NULL")
def filter_not_null(spark, sf):
    return fixtures.raw_users(spark, sf).filter(F.col("email").isNotNull())


@register("in_subquery", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
  AND (o_orderkey, o_custkey) IN (SELECT o_orderkey, o_custkey FROM orders
                                  WHERE o_orderpriority <> '1-URGENT')""")
def in_subquery(spark, sf):
    """Single-column and tuple IN (subquery) as semi joins."""
    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R")
    sub = o.filter(F.col("o_orderpriority") != "1-URGENT")
    r = predicates.is_in(o, li, "o_orderkey", "l_orderkey")
    r = predicates.is_in(r, sub, ["o_orderkey", "o_custkey"])
    return r.select("o_orderkey", "o_custkey", "o_totalprice")


NULLABLE_CUSTKEY = """orders_nk AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
         o_orderstatus FROM orders)"""


@register("not_in_subquery", with_(NULLABLE_CUSTKEY) + """
SELECT c_custkey, c_name FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL
SELECT c_custkey, c_name FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders_nk WHERE o_orderstatus = 'F')""")
def not_in_subquery(spark, sf):
    """NOT IN with SQL NULL semantics.  The first list (status P orders)
    has no NULL and keeps the customers absent from it; in the second every
    fifth order has a NULL customer, so that branch matches no customer."""
    c = table(spark, sf, "customer")
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.lit(None))
        .otherwise(F.col("o_custkey")).alias("o_custkey"), "o_orderstatus")
    clean = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P")
    a = predicates.not_in(c, clean, "c_custkey", "o_custkey")
    b = predicates.not_in(c, o.filter(F.col("o_orderstatus") == "F"), "c_custkey", "o_custkey")
    return a.select("c_custkey", "c_name").unionByName(b.select("c_custkey", "c_name"))


@register("cte_subquery", """
WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000)
SELECT S.o_custkey, S.n_big, S.max_price
FROM (SELECT o_custkey, count(*) AS n_big, max(o_totalprice) AS max_price
      FROM big GROUP BY o_custkey) S
WHERE S.n_big >= 2""")
def cte_subquery(spark, sf):
    """A CTE and a derived table, in Spark SQL over a bound DataFrame."""
    return spark.sql("""
        WITH big AS (SELECT o_custkey, o_totalprice FROM {orders} WHERE o_totalprice > 100000)
        SELECT S.o_custkey, S.n_big, S.max_price
        FROM (SELECT o_custkey, count(*) AS n_big, max(o_totalprice) AS max_price
              FROM big GROUP BY o_custkey) S
        WHERE S.n_big >= 2""", orders=table(spark, sf, "orders"))


@register("model_vars", with_(RAW_ORDERS) + """
SELECT order_id, user_id, amount_cents FROM raw_orders
WHERE status = 'open' AND amount_cents >= 20000000""")
def model_vars(spark, sf):
    """Project variables bound as named SQL parameters."""
    p = Project(spark, vars={"status": "open", "min_cents": 20000000})
    p.add_source("raw", {"orders": lambda: fixtures.raw_orders(spark, sf)})
    p.sql_model("big_open", """
        SELECT order_id, user_id, amount_cents FROM {orders}
        WHERE status = :status AND amount_cents >= :min_cents""",
                sources={"orders": ("raw", "orders")}, materialized="ephemeral")
    return p.run(["big_open"])["big_open"]


# --------------------------------------------------------------------------
# Joins


@register("join_cross", with_(RAW_ORDERS) + """,
stats AS (SELECT CAST(sum(amount_cents) AS BIGINT) / count(*) AS avg_cents, count(*) AS n_orders
          FROM raw_orders)
SELECT o.order_id, o.amount_cents, s.avg_cents, s.n_orders
FROM raw_orders o CROSS JOIN stats s""")
def join_cross(spark, sf):
    """A source with a one-row ephemeral model (global aggregate)."""
    p = Project(spark)
    p.add_source("raw", {"orders": lambda: fixtures.raw_orders(spark, sf)})
    # An exact integer sum divided once (avg() would sum doubles, whose
    # rounding depends on the order of the partial sums).
    p.model("stats", lambda c: c.source("raw", "orders").agg(
        (F.sum("amount_cents") / F.count(F.lit(1))).alias("avg_cents"),
        F.count(F.lit(1)).alias("n_orders")), materialized="ephemeral")
    p.model("with_stats", lambda c: predicates.attach_one_row(
        c.source("raw", "orders").select("order_id", "amount_cents"), c.ref("stats")),
        materialized="ephemeral")
    return p.run(["with_stats"])["with_stats"]


@register("join_anti", with_(RAW_ORDERS, RAW_USERS) + """
SELECT u.* FROM raw_users u
WHERE NOT EXISTS (SELECT 1 FROM raw_orders o WHERE o.user_id = u.user_id AND o.status = 'open')""")
def join_anti(spark, sf):
    """Users with no open order."""
    o = fixtures.raw_orders(spark, sf).filter(F.col("status") == "open")
    return predicates.anti(fixtures.raw_users(spark, sf), o, "user_id")


# --------------------------------------------------------------------------
# Aggregations


@register("agg_sum", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price,
       count(*) AS n_lines
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def agg_sum(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("sum_price"),
        F.count(F.lit(1)).alias("n_lines"))


@register("agg_count_distinct", with_(RAW_ORDERS) + """
SELECT status, count(DISTINCT user_id) AS buyers, count(*) AS n_orders
FROM raw_orders GROUP BY status""")
def agg_count_distinct(spark, sf):
    o = fixtures.raw_orders(spark, sf)
    return o.groupBy("status").agg(F.count_distinct("user_id").alias("buyers"),
                                   F.count(F.lit(1)).alias("n_orders"))


@register("agg_group_by_expr", with_(RAW_ORDERS) + """
SELECT date_trunc('month', created_at) AS month, count(*) AS n_orders,
       CAST(sum(amount_cents) AS BIGINT) AS total_cents
FROM raw_orders GROUP BY 1""")
def agg_group_by_expr(spark, sf):
    o = fixtures.raw_orders(spark, sf)
    return o.groupBy(H.month_start("created_at").alias("month")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("amount_cents").alias("total_cents"))


@register("agg_max_scalar", with_(RAW_ORDERS) + """
SELECT order_id, user_id, created_at FROM raw_orders
WHERE created_at = (SELECT max(created_at) FROM raw_orders)""")
def agg_max_scalar(spark, sf):
    o = fixtures.raw_orders(spark, sf)
    mx = o.agg(F.max("created_at")).scalar()
    return o.filter(F.col("created_at") == mx).select("order_id", "user_id", "created_at")


@register("agg_listagg", """
SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS event_types,
       count(*) AS n_types
FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id""")
def agg_listagg(spark, sf):
    """Per user, the distinct event types as one ordered string.

    The DISTINCT runs first (partial aggregation on the map side), so each
    user's group holds at most one row per event type however many events
    the user has.
    """
    e = table(spark, sf, "events").select("user_id", "event_type").distinct()
    return e.groupBy("user_id").agg(H.listagg("event_type", ",", "event_type").alias("event_types"),
                                    F.count(F.lit(1)).alias("n_types"))


@register("distinct_rows", with_(RAW_EVENTS) + "SELECT DISTINCT user_id, region FROM raw_events")
def distinct_rows(spark, sf):
    return fixtures.raw_events(spark, sf).select("user_id", "region").distinct()


# --------------------------------------------------------------------------
# Scalar helpers


@register("fn_surrogate_key", with_(RAW_ORDERS, NULLABLE_STATUS) + """
SELECT order_id,
       md5(concat(coalesce(CAST(order_id AS VARCHAR), '_dbt_utils_surrogate_key_null_'),
                  coalesce(CAST(status AS VARCHAR), '_dbt_utils_surrogate_key_null_'),
                  coalesce(CAST(created_at AS VARCHAR), '_dbt_utils_surrogate_key_null_')))
         AS sk,
       md5(coalesce(CAST(user_id AS VARCHAR), '_dbt_utils_surrogate_key_null_')) AS sk_user
FROM orders_ns""")
def fn_surrogate_key(spark, sf):
    o = _orders_nullable_status(spark, sf)
    return o.select("order_id", H.surrogate_key("order_id", "status", "created_at").alias("sk"),
                    H.surrogate_key("user_id").alias("sk_user"))


@register("fn_datediff", with_(RAW_ORDERS) + f"""
SELECT order_id,
       date_sub('day', created_at, TIMESTAMP '{FIXED_RUN_TS}') AS age_days,
       date_sub('hour', created_at, TIMESTAMP '{FIXED_RUN_TS}') AS age_hours,
       date_sub('year', created_at, TIMESTAMP '{FIXED_RUN_TS}') AS age_years
FROM raw_orders""")
def fn_datediff(spark, sf):
    o = fixtures.raw_orders(spark, sf)
    run = F.lit(FIXED_RUN_TS).cast("timestamp_ntz")
    return o.select("order_id", H.datediff("created_at", run, "day").alias("age_days"),
                    H.datediff("created_at", run, "hour").alias("age_hours"),
                    H.datediff("created_at", run, "year").alias("age_years"))


@register("fn_dateadd", with_(RAW_ORDERS) + """
SELECT order_id, created_at + INTERVAL 7 DAY AS plus_week,
       created_at + INTERVAL 1 MONTH AS plus_month,
       created_at - INTERVAL 3 HOUR AS minus_3h
FROM raw_orders""")
def fn_dateadd(spark, sf):
    o = fixtures.raw_orders(spark, sf)
    return o.select("order_id", H.dateadd("day", 7, "created_at").alias("plus_week"),
                    H.dateadd("month", 1, "created_at").alias("plus_month"),
                    H.dateadd("hour", -3, "created_at").alias("minus_3h"))


@register("fn_run_ts", with_(RAW_ORDERS) + f"""
SELECT order_id, TIMESTAMP '{FIXED_RUN_TS}' AS loaded_at FROM raw_orders""")
def fn_run_ts(spark, sf):
    o = fixtures.raw_orders(spark, sf)
    return o.select("order_id", H.run_timestamp(FIXED_RUN_TS).cast("timestamp_ntz").alias("loaded_at"))


@register("fn_date_trunc", with_(RAW_ORDERS) + """
SELECT order_id, date_trunc('month', created_at) AS month,
       date_trunc('year', created_at) AS year, date_trunc('quarter', created_at) AS quarter
FROM raw_orders""")
def fn_date_trunc(spark, sf):
    o = fixtures.raw_orders(spark, sf)
    return o.select("order_id", H.month_start("created_at").alias("month"),
                    H.month_start("created_at", "year").alias("year"),
                    H.month_start("created_at", "quarter").alias("quarter"))


@register("fn_safe_divide", with_(RAW_ORDERS) + """
SELECT order_id, amount_cents / nullif(order_id % 7, 0) AS ratio FROM raw_orders""")
def fn_safe_divide(spark, sf):
    o = fixtures.raw_orders(spark, sf)
    return o.select("order_id", H.safe_divide("amount_cents", F.col("order_id") % 7).alias("ratio"))


@register("fn_cents_to_dollars", with_(RAW_EVENTS) + """
SELECT event_id, CAST(amount_cents AS DOUBLE) / 100.0 AS dollars_float,
       round(amount_cents / 100, 2) AS dollars_round FROM raw_events""")
def fn_cents_to_dollars(spark, sf):
    e = fixtures.raw_events(spark, sf)
    return e.select("event_id", H.cents_to_dollars("amount_cents").alias("dollars_float"),
                    H.cents_to_dollars("amount_cents", rounded=True).alias("dollars_round"))


@register("fn_text", """
SELECT c_custkey, upper(c_name) AS name_upper, lower(c_mktsegment) AS segment_lower,
       concat(c_name, '/', c_mktsegment) AS label FROM customer""")
def fn_text(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.upper("c_name").alias("name_upper"),
                    F.lower("c_mktsegment").alias("segment_lower"),
                    F.concat("c_name", F.lit("/"), "c_mktsegment").alias("label"))


@register("fn_cast", with_(RAW_ORDERS) + """
SELECT order_id, CAST(amount_cents AS VARCHAR) AS cents_text,
       CAST(order_id AS DOUBLE) AS id_float,
       CAST(CAST(amount_cents AS VARCHAR) AS BIGINT) AS cents_back
FROM raw_orders""")
def fn_cast(spark, sf):
    o = fixtures.raw_orders(spark, sf)
    return o.select("order_id", F.col("amount_cents").cast("string").alias("cents_text"),
                    F.col("order_id").cast("double").alias("id_float"),
                    F.col("amount_cents").cast("string").cast("long").alias("cents_back"))


@register("macro_compose", with_(RAW_ORDERS) + """
SELECT order_id,
       (CAST(amount_cents AS DOUBLE) / 100.0) / nullif(CAST(order_id % 4 AS BIGINT), 0)
         AS dollars_per_slot
FROM raw_orders""")
def macro_compose(spark, sf):
    """a user macro that calls two other macros."""
    m = Macros()
    m.define("cents_to_dollars", H.cents_to_dollars)
    m.define("safe_divide", H.safe_divide)
    m.define("dollars_per", lambda x, d: m("safe_divide", m("cents_to_dollars", x), d))
    o = fixtures.raw_orders(spark, sf)
    return o.select("order_id", m("dollars_per", "amount_cents",
                                  F.col("order_id") % 4).alias("dollars_per_slot"))


@register("mart_revenue_textbook", MART_SQL)
def mart_revenue_textbook(spark, sf):
    """A8 with the aggregate after the join (``preaggregate=False``), kept to
    check that both plans of the revenue mart give equal rows."""
    p = revenue_project(spark, sf)
    return revenue_by_region_month(p.run(["int_enriched"])["int_enriched"],
                                   p.run(["stg_users"])["stg_users"], preaggregate=False)

