"""DuckDB SQL for the fixtures of ``stratum.plans.fixtures`` (used by the
oracle queries in ``stratum.plans.suite``)."""

RAW_ORDERS = """raw_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS user_id,
         CAST(round(o_totalprice * 100) AS BIGINT) AS amount_cents,
         CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'open'
              ELSE 'cancelled' END AS status,
         o_orderdate AS created_at
  FROM orders)"""

RAW_USERS = """raw_users AS (
  SELECT c_custkey AS user_id,
         CASE WHEN c_acctbal < 0 THEN NULL ELSE lower(c_name) || '@example.com' END AS email,
         r_name AS region,
         TIMESTAMP '2020-01-01 00:00:00' + c_custkey * INTERVAL 1 MINUTE AS created_at
  FROM customer JOIN nation ON c_nationkey = n_nationkey
                JOIN region ON n_regionkey = r_regionkey)"""

RAW_EVENTS = """raw_events AS (
  SELECT event_id, ts AS event_ts, 'R' || CAST(user_id % 5 AS VARCHAR) AS region,
         event_type, user_id, CAST(round(value * 100) AS BIGINT) AS amount_cents,
         {'k': CAST(json_extract(props, '$.k') AS BIGINT)} AS metadata
  FROM events)"""

STAGING = """stg_orders AS (
  SELECT order_id, user_id, amount_cents, status, created_at
  FROM raw_orders WHERE status != 'cancelled'),
stg_users AS (
  SELECT user_id, email, region, created_at FROM raw_users WHERE email IS NOT NULL),
int_enriched AS (
  SELECT order_id, user_id, CAST(amount_cents AS DOUBLE) / 100.0 AS amount_dollars,
         status, created_at FROM stg_orders),
int_joined AS (
  SELECT e.order_id, e.user_id, u.region, e.amount_dollars, e.created_at
  FROM int_enriched e JOIN stg_users u ON e.user_id = u.user_id)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
