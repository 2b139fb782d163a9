"""Reshape the generated test tables into the schemas the reference's example
projects use (raw orders / users / events).  Every registered query reads the
whole tables through these, so its work grows with the data.  The same
derivations are spelled in SQL in ``stratum.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.session import table


def raw_orders(spark: SparkSession, sf: str) -> DataFrame:
    """orders -> (order_id, user_id, amount_cents, status, created_at)."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("amount_cents"),
        F.when(F.col("o_orderstatus") == "F", "complete")
         .when(F.col("o_orderstatus") == "O", "open")
         .otherwise("cancelled").alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


def raw_users(spark: SparkSession, sf: str) -> DataFrame:
    """customer + nation + region -> (user_id, email, region, created_at).

    A negative balance stands for a missing e-mail (the data has no NULLs).
    nation and region are dimension tables of fixed size (25 and 5 rows), so
    the optimizer broadcasts them from their measured file sizes.
    """
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    return (c.join(n, c.c_nationkey == n.n_nationkey)
             .join(r, n.n_regionkey == r.r_regionkey)
             .select(F.col("c_custkey").alias("user_id"),
                     F.when(F.col("c_acctbal") < 0, F.lit(None).cast("string"))
                      .otherwise(F.concat(F.lower("c_name"), F.lit("@example.com")))
                      .alias("email"),
                     F.col("r_name").alias("region"),
                     F.timestamp_add("MINUTE", F.col("c_custkey"),
                                     F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"))
                      .alias("created_at")))


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    """events -> (event_ts, region, event_type, user_id, amount_cents, metadata).

    ``props`` is JSON text; it is parsed into the nested STRUCT the reference's
    event schema has.
    """
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id"),
        F.col("ts").alias("event_ts"),
        F.concat(F.lit("R"), (F.col("user_id") % 5).cast("string")).alias("region"),
        F.col("event_type"),
        F.col("user_id"),
        F.round(F.col("value") * 100).cast("long").alias("amount_cents"),
        F.from_json("props", "k BIGINT").alias("metadata"),
    )
