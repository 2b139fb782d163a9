"""Queries for routines (R1-R4) and the materialized view (K3)."""

from __future__ import annotations

import datetime as dt
import uuid

import pandas as pd
from pyspark.sql import functions as F

from stratum.functions import routines
from stratum.plans import fixtures
from stratum.plans.oracle import RAW_ORDERS, RAW_USERS, with_
from stratum.plans.project import Project
from stratum.plans.suite import register
from stratum.session import table

ORDERS = with_(RAW_ORDERS)


def _view(df, prefix: str) -> str:
    name = f"{prefix}_{uuid.uuid4().hex[:8]}"
    df.createOrReplaceTempView(name)
    return name


@register("sql_udf", ORDERS + """
SELECT order_id, CAST(amount_cents AS DOUBLE) / 100.0 AS amount_dollars,
       CASE WHEN amount_cents >= 20000000 THEN 'large' ELSE 'regular' END AS size_class
FROM raw_orders""")
def sql_udf(spark, sf):
    """Scalar SQL functions with typed arguments and return types."""
    routines.create_sql_function(spark, "cents_to_dollars", [("x", "BIGINT")], "DOUBLE",
                                 "CAST(x AS DOUBLE) / 100.0")
    routines.create_sql_function(spark, "size_class", [("x", "BIGINT"), ("lim", "BIGINT")],
                                 "STRING", "CASE WHEN x >= lim THEN 'large' ELSE 'regular' END")
    v = _view(fixtures.raw_orders(spark, sf), "orders")
    return spark.sql(f"SELECT order_id, cents_to_dollars(amount_cents) AS amount_dollars, "
                     f"size_class(amount_cents, 20000000) AS size_class FROM {v}")


@register("sql_udtf", ORDERS + """
SELECT user_id, count(*) AS n_orders, CAST(sum(amount_cents) AS BIGINT) AS total_cents
FROM raw_orders WHERE status = 'open' GROUP BY user_id""")
def sql_udtf(spark, sf):
    """R2: a table-valued SQL function over a stored view, with an argument."""
    v = _view(fixtures.raw_orders(spark, sf), "orders")
    name = f"orders_by_status_{uuid.uuid4().hex[:6]}"
    routines.create_table_function(
        spark, name, [("st", "STRING")],
        [("user_id", "BIGINT"), ("n_orders", "BIGINT"), ("total_cents", "BIGINT")],
        f"SELECT user_id, count(*), sum(amount_cents) FROM {v} WHERE status = st GROUP BY user_id")
    return spark.sql(f"SELECT * FROM {name}('open')")


@register("procedure", ORDERS + """
SELECT order_id, user_id, amount_cents FROM raw_orders
WHERE status = 'complete' AND amount_cents >= 30000000""")
def procedure(spark, sf):
    """A named SQL script called with parameters."""
    v = _view(fixtures.raw_orders(spark, sf), "orders")
    proc = routines.Procedure("big_orders", f"""
        BEGIN
          DECLARE lim BIGINT DEFAULT 30000000;
          SELECT order_id, user_id, amount_cents FROM {v}
          WHERE status = :status AND amount_cents >= lim;
        END""")
    return proc.call(spark, status="complete")


def _mask(emails: pd.Series) -> pd.Series:
    user = emails.str.split("@").str[0]
    domain = emails.str.split("@").str[1]
    return user.str[:1] + "***@" + domain


@register("python_udf", with_(RAW_USERS) + """
SELECT user_id, substr(email, 1, 1) || '***@' || split_part(email, '@', 2) AS masked_email
FROM raw_users""")
def python_udf(spark, sf):
    """A vectorized (Arrow batch) Python function; NULLs pass through."""
    mask = routines.python_function(_mask, "string", "DETERMINISTIC")
    u = fixtures.raw_users(spark, sf)
    return u.select("user_id", mask("email").alias("masked_email"))


MV_SQL = """
WITH run1 AS (SELECT event_type, count(*) AS n_events, CAST(sum(round(value * 100)) AS BIGINT) AS cents
              FROM events WHERE ts < TIMESTAMP '2024-01-16 00:00:00' GROUP BY event_type),
     run3 AS (SELECT event_type, count(*) AS n_events, CAST(sum(round(value * 100)) AS BIGINT) AS cents
              FROM events GROUP BY event_type)
SELECT *, 'fresh_enough' AS served FROM run1
UNION ALL SELECT *, 'refreshed' AS served FROM run3"""


@register("mat_materialized_view", MV_SQL)
def mat_materialized_view(spark, sf):
    """K3: a stored aggregate with a one-hour staleness bound.  Built at
    t0; read at t0+30min after the source grew (still fresh: the stored
    result is served); read at t0+2h (stale: rebuilt)."""
    e = table(spark, sf, "events")
    p = Project(spark, vars={"full": False})
    p.add_source("raw", {"events": lambda: e if p.var("full") else
                         e.filter(F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"))})
    p.model("event_totals", lambda c: c.source("raw", "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum(F.round(F.col("value") * 100)).cast("long").alias("cents")),
        materialized="materialized_view", max_staleness=dt.timedelta(hours=1))
    t0 = dt.datetime(2024, 2, 1, 6, 0, 0)
    p.run(["event_totals"], run_ts=t0)
    p.vars["full"] = True
    p.run(["event_totals"], run_ts=t0 + dt.timedelta(minutes=30))
    served_version = p.store.info("event_totals")["version"]
    refreshed = p.run(["event_totals"], run_ts=t0 + dt.timedelta(hours=2))["event_totals"]
    fresh = p.store.read("event_totals", version=served_version)
    return (fresh.withColumn("served", F.lit("fresh_enough"))
            .unionByName(refreshed.withColumn("served", F.lit("refreshed"))))
