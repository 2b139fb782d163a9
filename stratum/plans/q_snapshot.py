"""Queries for SCD2 snapshots.

Two generations of the customer table are the snapshot source:

* v1: every customer, version time 2024-01-01;
* v2: AUTOMOBILE customers are gone (hard deletes), BUILDING customers have a
  new balance and version time 2024-02-01, customers of nations 0-2 appear
  again under new keys (new rows).

The oracle spells the reference's three statements (invalidate, insert,
hard delete) literally as CTEs; the Spark side runs the one-pass plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.operators import snapshot as scd
from stratum.plans.snapshots import VERSION, SnapshotTable
from stratum.plans.store import TableStore
from stratum.plans.suite import register
from stratum.session import table

RUN1 = "2024-01-01 06:00:00"
RUN2 = "2024-02-01 06:00:00"
V1_TS = "2024-01-01 00:00:00"
V2_TS = "2024-02-01 00:00:00"
TS = "timestamp_ntz"


def _lit_ts(s):
    return F.lit(s).cast(TS)


def source_v1(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"),
                    F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
                    F.col("c_nationkey").alias("nation"), _lit_ts(V1_TS).alias("updated_at"))


def source_v2(spark, sf, with_tier: bool = False) -> DataFrame:
    v1 = source_v1(spark, sf)
    changed = F.col("segment") == "BUILDING"
    kept = (v1.filter(F.col("segment") != "AUTOMOBILE")
            .withColumn("balance", F.when(changed, F.col("balance") + 1).otherwise(F.col("balance")))
            .withColumn("updated_at", F.when(changed, _lit_ts(V2_TS)).otherwise(F.col("updated_at"))))
    new = (v1.filter(F.col("nation") < 3)
           .withColumn("customer_id", F.col("customer_id") + 10000000)
           .withColumn("updated_at", _lit_ts(V2_TS)))
    out = kept.unionByName(new)
    if with_tier:
        out = out.withColumn("tier", F.when(F.col("balance") > 5000, "gold").otherwise("std"))
    return out


V_SQL = f"""v1 AS (
  SELECT c_custkey AS customer_id, c_name AS name, c_acctbal AS balance,
         c_mktsegment AS segment, c_nationkey AS nation, TIMESTAMP '{V1_TS}' AS updated_at
  FROM customer),
v2 AS (
  SELECT customer_id, name,
         CASE WHEN segment = 'BUILDING' THEN balance + 1 ELSE balance END AS balance,
         segment, nation,
         CASE WHEN segment = 'BUILDING' THEN TIMESTAMP '{V2_TS}' ELSE updated_at END AS updated_at
  FROM v1 WHERE segment != 'AUTOMOBILE'
  UNION ALL
  SELECT customer_id + 10000000, name, balance, segment, nation, TIMESTAMP '{V2_TS}'
  FROM v1 WHERE nation < 3),
snap1 AS (
  SELECT v1.*, md5(CAST(customer_id AS VARCHAR) || '|' || CAST(updated_at AS VARCHAR)) AS dbt_scd_id,
         updated_at AS dbt_updated_at, TIMESTAMP '{RUN1}' AS dbt_valid_from,
         CAST(NULL AS TIMESTAMP) AS dbt_valid_to
  FROM v1)"""


def steps_sql(src: str = "v2") -> str:
    """The three statements of a snapshot run as CTEs over source ``src``:
    s1 = after invalidate, ins = inserted versions, s2 = after insert,
    s3 = after hard delete."""
    return f""",
s1 AS (
  SELECT * REPLACE (
    CASE WHEN dbt_valid_to IS NULL AND customer_id IN (
           SELECT {src}.customer_id FROM {src} WHERE {src}.updated_at > snap1.dbt_updated_at)
         THEN TIMESTAMP '{RUN2}' ELSE dbt_valid_to END AS dbt_valid_to)
  FROM snap1),
ins AS (
  SELECT {src}.*,
         md5(CAST({src}.customer_id AS VARCHAR) || '|' || CAST({src}.updated_at AS VARCHAR))
           AS dbt_scd_id,
         {src}.updated_at AS dbt_updated_at, TIMESTAMP '{RUN2}' AS dbt_valid_from,
         CAST(NULL AS TIMESTAMP) AS dbt_valid_to
  FROM {src} LEFT JOIN s1 ON {src}.customer_id = s1.customer_id AND s1.dbt_valid_to IS NULL
  WHERE s1.customer_id IS NULL OR {src}.updated_at > s1.dbt_updated_at),
s2 AS (SELECT * FROM s1 UNION ALL SELECT * FROM ins),
s3 AS (
  SELECT * REPLACE (
    CASE WHEN dbt_valid_to IS NULL AND customer_id NOT IN (SELECT customer_id FROM {src})
         THEN TIMESTAMP '{RUN2}' ELSE dbt_valid_to END AS dbt_valid_to)
  FROM s2)"""


STEPS_SQL = V_SQL + steps_sql("v2")


def _snap1(spark, sf):
    return scd.initial(source_v1(spark, sf), "customer_id", "updated_at", RUN1, TS)


@register("scd2_initial", "WITH " + V_SQL + " SELECT * FROM snap1")
def scd2_initial(spark, sf):
    return _snap1(spark, sf)


@register("scd2_invalidate", "WITH " + STEPS_SQL + " SELECT * FROM s1")
def scd2_invalidate(spark, sf):
    return scd.invalidate(_snap1(spark, sf), source_v2(spark, sf), "customer_id", "updated_at",
                          RUN2, TS)


@register("scd2_insert", "WITH " + STEPS_SQL + " SELECT * FROM ins")
def scd2_insert(spark, sf):
    s1 = scd.invalidate(_snap1(spark, sf), source_v2(spark, sf), "customer_id", "updated_at",
                        RUN2, TS)
    return scd.insert_versions(s1, source_v2(spark, sf), "customer_id", "updated_at", RUN2, TS)


@register("scd2_hard_delete", "WITH " + V_SQL + f"""
SELECT * REPLACE (
  CASE WHEN dbt_valid_to IS NULL AND customer_id NOT IN (SELECT customer_id FROM v2)
       THEN TIMESTAMP '{RUN2}' ELSE dbt_valid_to END AS dbt_valid_to)
FROM snap1""")
def scd2_hard_delete(spark, sf):
    return scd.hard_delete(_snap1(spark, sf), source_v2(spark, sf), "customer_id", RUN2, TS)


def _stored_cycle(spark, sf, auto_optimize=True) -> SnapshotTable:
    st = SnapshotTable(TableStore(spark), "customers_snapshot", "customer_id", "updated_at",
                       hard_deletes=True, auto_optimize=auto_optimize, ts_type=TS)
    st.run(source_v1(spark, sf), RUN1)
    st.run(source_v2(spark, sf), RUN2)
    return st


@register("scd2_full_cycle", "WITH " + STEPS_SQL + " SELECT * FROM s3")
def scd2_full_cycle(spark, sf):
    """Two stored runs (initial, then invalidate + insert + hard delete)."""
    return _stored_cycle(spark, sf).read()


@register("scd2_as_of", "WITH " + STEPS_SQL + f"""
SELECT *, 'first' AS at FROM s3 WHERE dbt_valid_from <= TIMESTAMP '2024-01-15 00:00:00' AND (dbt_valid_to IS NULL OR dbt_valid_to > TIMESTAMP '2024-01-15 00:00:00')
UNION ALL SELECT *, 'second' AS at FROM s3 WHERE dbt_valid_from <= TIMESTAMP '{RUN2}' AND (dbt_valid_to IS NULL OR dbt_valid_to > TIMESTAMP '{RUN2}')
UNION ALL SELECT *, 'before' AS at FROM s3 WHERE dbt_valid_from <= TIMESTAMP '2020-01-01 00:00:00'""")
def scd2_as_of(spark, sf):
    """N5 as of three times: between the runs, at the second, before the first;
    each reads the folders whose validity can hold the time."""
    st = _stored_cycle(spark, sf)
    at = lambda when, name: st.as_of(when).withColumn("at", F.lit(name))
    return at("2024-01-15 00:00:00", "first").unionByName(at(RUN2, "second")).unionByName(at("2020-01-01 00:00:00", "before"))


@register("scd2_one_pass", "WITH " + STEPS_SQL + " SELECT * FROM s3")
def scd2_one_pass(spark, sf):
    """N5 as a pure function over an in-memory snapshot (no store)."""
    return scd.cycle(_snap1(spark, sf), source_v2(spark, sf), "customer_id", "updated_at",
                     RUN2, hard_deletes=True, ts_type=TS)


@register("current_rows", "WITH " + STEPS_SQL + " SELECT * FROM s3 WHERE dbt_valid_to IS NULL")
def current_rows(spark, sf):
    """P10: open versions after the second run."""
    return scd.current_rows(_stored_cycle(spark, sf, auto_optimize=False).read())


@register("scd2_layout", "WITH " + STEPS_SQL + """
SELECT customer_id, dbt_valid_from, dbt_valid_to, CAST(dbt_valid_from AS DATE) AS _partition_time,
       CASE WHEN dbt_valid_to IS NULL THEN 'open' ELSE 'closed' END AS _state
FROM s3""")
def scd2_layout(spark, sf):
    """The stored layout -- partition by day of dbt_valid_from, state,
    files clustered by key."""
    st = _stored_cycle(spark, sf)
    n = st.version()
    d = st._dataset()
    keep = (((F.col("_state") == "closed") & (F.col(VERSION) <= n))
            | ((F.col("_state") == "open") & (F.col(VERSION) == n)))
    return d.filter(keep).select("customer_id", "dbt_valid_from", "dbt_valid_to",
                                 "_partition_time", "_state")


@register("scd2_scd_id", f"""
SELECT c_custkey AS customer_id,
       md5(CAST(c_custkey AS VARCHAR) || '|' ||
           CAST(CASE WHEN c_nationkey = 5 THEN NULL ELSE TIMESTAMP '{V1_TS}' END AS VARCHAR)) AS dbt_scd_id
FROM customer""")
def scd2_scd_id(spark, sf):
    """The row id, NULL when a part is NULL."""
    v = source_v1(spark, sf).withColumn(
        "updated_at", F.when(F.col("nation") == 5, F.lit(None)).otherwise(F.col("updated_at")))
    return v.select("customer_id", scd.scd_id("customer_id", "updated_at").alias("dbt_scd_id"))


@register("scd2_new_columns", "WITH " + V_SQL + """,
v2t AS (SELECT *, CASE WHEN balance > 5000 THEN 'gold' ELSE 'std' END AS tier FROM v2)"""
          + steps_sql("v2t").replace("s2 AS (SELECT * FROM s1 UNION ALL SELECT * FROM ins),",
                                     "s2 AS (SELECT *, NULL AS tier FROM s1),") + """
SELECT customer_id, name, balance, segment, nation, updated_at, NULL AS tier,
       dbt_scd_id, dbt_updated_at, dbt_valid_from, dbt_valid_to FROM s1
UNION ALL
SELECT customer_id, name, balance, segment, nation, updated_at, tier,
       dbt_scd_id, dbt_updated_at, dbt_valid_from, dbt_valid_to FROM ins""")
def scd2_new_columns(spark, sf):
    """The source gained ``tier``; history rows get NULL there."""
    return scd.cycle(_snap1(spark, sf), source_v2(spark, sf, with_tier=True), "customer_id",
                     "updated_at", RUN2, hard_deletes=False, ts_type=TS)


@register("join_left_open", "WITH " + V_SQL + """
SELECT v2.* FROM v2 LEFT JOIN snap1 s ON v2.customer_id = s.customer_id AND s.dbt_valid_to IS NULL
WHERE s.customer_id IS NULL OR v2.updated_at > s.dbt_updated_at""")
def join_left_open(spark, sf):
    """Source rows without an open version or newer than it."""
    return scd.changed_or_new(source_v2(spark, sf), scd.current_rows(_snap1(spark, sf)),
                              "customer_id", "updated_at")


@register("join_semi_correlated", "WITH " + V_SQL + """
SELECT * FROM snap1 WHERE dbt_valid_to IS NULL AND customer_id IN (
  SELECT v2.customer_id FROM v2 WHERE v2.updated_at > snap1.dbt_updated_at)""")
def join_semi_correlated(spark, sf):
    """Open rows for which the source has a newer row."""
    return scd.newer_in_source(scd.current_rows(_snap1(spark, sf)), source_v2(spark, sf),
                               "customer_id", "updated_at")
