"""Queries for schema evolution, drift, contracts and types."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stratum.operators import contracts, evolve
from stratum.plans import fixtures
from stratum.plans.oracle import RAW_EVENTS, RAW_ORDERS, RAW_USERS, with_
from stratum.plans.store import TableStore
from stratum.plans.suite import register
from stratum.types import Field, align

ORDERS = with_(RAW_ORDERS)


@register("evolve_insert", ORDERS + """
SELECT *, CAST(NULL AS DOUBLE) AS discount, CAST(NULL AS VARCHAR[]) AS tags,
       'web' AS channel FROM raw_orders""")
def evolve_insert(spark, sf):
    """Add columns; ``status`` is already there and is skipped; the
    default fills ``channel`` because backfill is on."""
    o = fixtures.raw_orders(spark, sf)
    return evolve.evolve(o, [
        Field("discount", "FLOAT64", alter="insert", description="discount rate"),
        Field("tags", "STRING", "REPEATED", alter="insert"),
        Field("channel", "STRING", alter="insert", default_value_expression="'web'"),
        Field("status", "STRING", alter="insert"),
    ], backfill=True)


@register("evolve_drop", ORDERS + "SELECT order_id, user_id, amount_cents, created_at FROM raw_orders")
def evolve_drop(spark, sf):
    """Drop ``status``; dropping the absent ``legacy`` is skipped."""
    o = fixtures.raw_orders(spark, sf)
    return evolve.drop_columns(o, ["status", "legacy"],
                               consumers=[{"name": "fct_orders", "unique_key": ["order_id"],
                                           "partition_by": ["created_at"]}])


@register("evolve_rename", ORDERS + """
SELECT order_id, user_id AS customer_id, amount_cents, status, created_at FROM raw_orders""")
def evolve_rename(spark, sf):
    """Rename user_id; a rename whose source is gone is skipped."""
    o = fixtures.raw_orders(spark, sf)
    return evolve.evolve(o, [Field("customer_id", "INT64", alter="rename", alter_from="user_id"),
                             Field("x", "INT64", alter="rename", alter_from="no_such_column")])


@register("evolve_rename_swap", ORDERS + """
SELECT user_id AS order_id, order_id AS user_id, amount_cents,
       created_at AS status, status AS state FROM raw_orders""")
def evolve_rename_swap(spark, sf):
    """A swap (order_id <-> user_id) and a chain (status -> state,
    created_at -> status) applied at once."""
    o = fixtures.raw_orders(spark, sf)
    return evolve.rename_columns(o, {"order_id": "user_id", "user_id": "order_id",
                                     "status": "state", "created_at": "status"})


COMBINED = [
    Field("order_id", "INT64", "REQUIRED", description="order key"),
    Field("buyer_id", "INT64", alter="rename", alter_from="user_id"),
    Field("amount_cents", "INT64", description="amount in cents"),
    Field("status", alter="delete"),
    Field("created_at", "DATETIME"),
    Field("channel", "STRING", alter="insert", description="sales channel"),
]


@register("evolve_combined", ORDERS + """
SELECT order_id, user_id AS buyer_id, amount_cents, created_at, CAST(NULL AS VARCHAR) AS channel
FROM raw_orders""")
def evolve_combined(spark, sf):
    """E5: drop -> rename -> add -> describe in one projection."""
    return evolve.evolve(fixtures.raw_orders(spark, sf), COMBINED)


@register("evolve_chain", ORDERS + """
SELECT order_id, user_id AS full_buyer, amount_cents, created_at,
       CAST(NULL AS VARCHAR) AS city_name, CAST(NULL AS VARCHAR) AS phone
FROM raw_orders""")
def evolve_chain(spark, sf):
    """Four successive stored evolutions keep the data:
    +age +city; city -> city_name; status dropped; user_id -> full_buyer,
    age dropped, phone added."""
    store = TableStore(spark)
    store.write("orders_evo", fixtures.raw_orders(spark, sf))
    steps = [
        [Field("age", "INT64", alter="insert"), Field("city", "STRING", alter="insert")],
        [Field("city_name", "STRING", alter="rename", alter_from="city")],
        [Field("status", alter="delete")],
        [Field("full_buyer", "INT64", alter="rename", alter_from="user_id"),
         Field("age", alter="delete"), Field("phone", "STRING", alter="insert")],
    ]
    for fields in steps:
        # metadata only: the files written first are never rewritten
        store.evolve("orders_evo", fields)
    return store.read("orders_evo")


DECLARED_ORDERS = [
    Field("order_id", "INT64"), Field("user_id", "INT64"), Field("amount_cents", "FLOAT"),
    Field("status", "STRING"), Field("created_at", "DATETIME"),
]


@register("type_cast_align", ORDERS + """
SELECT order_id, user_id, CAST(amount_cents AS DOUBLE) AS amount_cents, status, created_at
FROM raw_orders""")
def type_cast_align(spark, sf):
    """Align to a declared schema with alias types (FLOAT -> DOUBLE)."""
    return align(fixtures.raw_orders(spark, sf), DECLARED_ORDERS)


@register("schema_drift", with_(RAW_ORDERS, RAW_USERS) + """
SELECT * FROM (VALUES
  ('orders', 'user_id', 'type_mismatch', 'STRING', 'INT64', 0),
  ('orders', 'status', 'type_mismatch', 'INT64', 'STRING',
      (SELECT count(*) FROM raw_orders WHERE status IS NOT NULL
                                         AND TRY_CAST(status AS BIGINT) IS NULL)),
  ('orders', 'discount', 'missing', 'FLOAT64', NULL, NULL),
  ('orders', 'created_at', 'extra', NULL, 'DATETIME',
      (SELECT count(created_at) FROM raw_orders)),
  ('users', 'created_at', 'type_mismatch', 'TIMESTAMP', 'DATETIME', 0),
  ('users', 'signup_source', 'missing', 'STRING', NULL, NULL),
  ('users', 'email', 'extra', NULL, 'STRING', (SELECT count(email) FROM raw_users))
) AS t(table_name, column_name, kind, declared_type, actual_type, affected_rows)""")
def schema_drift(spark, sf):
    """Drift over two tables, names compared case-insensitively."""
    return contracts.drift_report({
        "orders": (fixtures.raw_orders(spark, sf), [
            Field("ORDER_ID", "INT64"), Field("user_id", "STRING"), Field("amount_cents", "INTEGER"),
            Field("status", "INT64"), Field("discount", "FLOAT64")]),
        "users": (fixtures.raw_users(spark, sf), [
            Field("user_id", "BIGINT"), Field("Region", "STRING"),
            Field("created_at", "TIMESTAMP"), Field("signup_source", "STRING")]),
    })


CONTRACT_FIELDS = [
    Field("order_id", "INT64", "REQUIRED"), Field("user_id", "INT64", "REQUIRED"),
    Field("amount_cents", "FLOAT64"), Field("status", "STRING"),
    Field("note", "STRING"), Field("tags", "STRING", "REPEATED"),
    Field("email", "STRING", "REQUIRED"), Field("channel", "STRING", alter="insert"),
]


@register("schema_contract", with_(RAW_ORDERS, RAW_USERS) + """,
j AS (SELECT o.*, u.email FROM raw_orders o JOIN raw_users u ON o.user_id = u.user_id)
SELECT * FROM (VALUES
  ('undeclared_column', 'created_at', 'DATETIME', NULL),
  ('required_null', 'order_id', NULL, (SELECT count(*) FROM j WHERE order_id IS NULL)),
  ('required_null', 'user_id', NULL, (SELECT count(*) FROM j WHERE user_id IS NULL)),
  ('type_mismatch', 'amount_cents', 'FLOAT64 <> INT64', 0),
  ('missing_column', 'note', 'STRING', NULL),
  ('required_null', 'email', NULL, (SELECT count(*) FROM j WHERE email IS NULL)),
  ('missing_cluster_by_column', 'region', NULL, NULL),
  ('duplicate_key', 'user_id', NULL,
      (SELECT count(*) FROM (SELECT user_id FROM j WHERE user_id IS NOT NULL
                             GROUP BY user_id HAVING count(*) > 1)))
) AS t("check", column_name, detail, violations)""")
def schema_contract(spark, sf):
    """Contract of orders-with-email against a declared schema."""
    o = fixtures.raw_orders(spark, sf)
    u = fixtures.raw_users(spark, sf).select("user_id", "email")
    return contracts.contract(o.join(u, "user_id").select(*o.columns, "email"), CONTRACT_FIELDS,
                              unique_key=["user_id"], partition_by=["created_at"],
                              cluster_by=["region"])


@register("required_check", with_(RAW_USERS) + """
SELECT * FROM (VALUES
  ('user_id', (SELECT count(*) FROM raw_users WHERE user_id IS NULL)),
  ('email', (SELECT count(*) FROM raw_users WHERE email IS NULL))
) AS t(column_name, null_rows)""")
def required_check(spark, sf):
    """NULLs per REQUIRED column."""
    return contracts.required_nulls(fixtures.raw_users(spark, sf), [
        Field("user_id", "INT64", "REQUIRED"), Field("email", "STRING", "REQUIRED"),
        Field("region", "STRING")])


@register("round_mode", ORDERS + """
SELECT order_id,
       CAST(round(CAST(amount_cents AS DECIMAL(20,0)) * CAST(0.001 AS DECIMAL(4,3)), 2)
            AS DECIMAL(20,2)) AS half_away,
       CAST(round_even(CAST(amount_cents AS DECIMAL(20,0)) * CAST(0.001 AS DECIMAL(4,3)), 2)
            AS DECIMAL(20,2)) AS half_even
FROM raw_orders""")
def round_mode(spark, sf):
    """The two rounding modes on exact decimals (x.xx5 ties differ)."""
    o = fixtures.raw_orders(spark, sf)
    x = F.col("amount_cents").cast("decimal(20,0)") * F.lit(0.001).cast("decimal(4,3)")
    return o.select("order_id",
                    evolve.round_column(x, "ROUND_HALF_AWAY_FROM_ZERO", 2)
                    .cast("decimal(20,2)").alias("half_away"),
                    evolve.round_column(x, "ROUND_HALF_EVEN", 2)
                    .cast("decimal(20,2)").alias("half_even"))


NESTED = [
    Field("event_id", "INT64", "REQUIRED"),
    Field("metadata", "RECORD", fields=[Field("source", "STRING"), Field("version", "INT64")]),
    Field("tags", "STRING", "REPEATED"),
]


@register("nested_struct", with_(RAW_EVENTS) + """,
n AS (SELECT event_id, {'source': event_type, 'version': metadata.k} AS metadata,
             [event_type, region] AS tags FROM raw_events)
SELECT event_id, metadata.source AS meta_source, metadata.version AS meta_version,
       CAST(len(tags) AS INTEGER) AS n_tags, tags[2] AS second_tag FROM n""")
def nested_struct(spark, sf):
    """STRUCT and REPEATED columns built, aligned to a declared nested
    schema, then read back by path."""
    e = fixtures.raw_events(spark, sf)
    n = e.select("event_id",
                 F.struct(F.col("event_type").alias("source"),
                          F.col("metadata.k").alias("version")).alias("metadata"),
                 F.array("event_type", "region").alias("tags"))
    a = align(n, NESTED)
    return a.select("event_id", F.col("metadata.source").alias("meta_source"),
                    F.col("metadata.version").alias("meta_version"),
                    F.size("tags").alias("n_tags"), F.col("tags")[1].alias("second_tag"))


@register("contract_enforced", ORDERS + """
SELECT order_id, user_id, amount_cents, status, 'unique key' AS refused FROM raw_orders WHERE order_id % 2 = 0
UNION ALL SELECT order_id, user_id, amount_cents, status, 'REQUIRED' FROM raw_orders WHERE order_id % 2 = 0""")
def contract_enforced(spark, sf):
    """E9, E10 at build time: a rebuild that repeats a key, and one that has
    NULLs where none may be, are not committed; the first version stays."""
    from stratum.plans.project import Project
    from stratum.plans.store import CheckFailed
    good = fixtures.raw_orders(spark, sf).filter("order_id % 2 = 0").select("order_id", "user_id", "amount_cents", "status")
    broken = {"unique key": good.unionByName(good.filter("order_id % 16 = 0")),
              "REQUIRED": good.withColumn("user_id", F.when(F.col("order_id") % 16 != 0, F.col("user_id")))}
    out = None
    for why, rows in broken.items():
        p = Project(spark, vars={"rows": good})
        p.model("orders", lambda c: c.var("rows"), materialized="table", unique_key="order_id",
                contract=[Field("order_id", "INT64", "REQUIRED"), Field("user_id", "INT64", "REQUIRED"), Field("amount_cents", "INT64"), Field("status", "STRING")])
        p.run()
        p.vars["rows"] = rows
        try:
            p.run()
            refused = "nothing"
        except (CheckFailed, PySparkException) as e:   # noqa: PERF203
            refused = why if why in str(e) else "something else"
        kept = p.store.read("orders").withColumn("refused", F.lit(refused))
        out = kept if out is None else out.unionByName(kept)
    return out
