"""Scale properties of the physical plans (checked with ``explain``)."""

import io
from contextlib import contextmanager, redirect_stdout

from stratum.operators import evolve, predicates, strategies as S
from stratum.plans import fixtures, q_incremental as QI, q_schema as QE, q_snapshot as QS
from stratum.plans.marts import revenue_by_region_month, revenue_project


def plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


@contextmanager
def no_broadcast(spark):
    """The plan shape at scale: nothing is small enough to broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_not_in_never_becomes_a_nested_loop(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    o = spark.read.parquet(f"{sf}/orders.parquet")
    with no_broadcast(spark):
        ours = plan(predicates.not_in(c, o, "c_custkey", "o_custkey"))
        c.createOrReplaceTempView("c_plan")
        o.createOrReplaceTempView("o_plan")
        builtin = plan(spark.sql(
            "SELECT * FROM c_plan WHERE c_custkey NOT IN (SELECT o_custkey FROM o_plan)"))
    # ours: an ordinary shuffled anti join, nothing broadcast
    assert "NestedLoopJoin" not in ours and "BroadcastExchange" not in ours
    assert "SortMergeJoin" in ours
    # Spark's own NOT IN broadcasts the whole subquery even with broadcasting
    # switched off (null-aware anti join), or falls back to a nested loop
    assert "BroadcastExchange" in builtin or "NestedLoopJoin" in builtin


def test_evolution_is_one_projection(spark, sf):
    p = plan(evolve.evolve(fixtures.raw_orders(spark, sf), QE.COMBINED))
    assert "Exchange" not in p and "Join" not in p
    # the dropped column is not read at all
    assert "o_orderstatus" not in p.split("ReadSchema:")[1]


def test_mart_scans_only_needed_columns_and_pre_aggregates(spark, sf):
    pr = revenue_project(spark, sf)
    df = revenue_by_region_month(pr.run(["int_enriched"])["int_enriched"],
                                 pr.run(["stg_users"])["stg_users"])
    with no_broadcast(spark):
        p = plan(df)
    orders_schema = [s for s in p.split("ReadSchema: ")[1:] if "o_custkey" in s][0].split()[0]
    assert "o_orderpriority" not in orders_schema and "o_orderkey" not in orders_schema
    # partial aggregation of orders happens before their first shuffle
    assert "partial_sum" in p
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p


def test_merge_keeps_the_target_streamed(spark, sf):
    p = plan(S.merge_upsert(QI._target(spark, sf), QI._source(spark, sf), "order_id"))
    # a broadcast, if any, is of the increment's key counts, on the build (right) side
    assert "BuildLeft" not in p
    with no_broadcast(spark):
        p = plan(S.merge_upsert(QI._target(spark, sf), QI._source(spark, sf), "order_id"))
    assert "SortMergeJoin" in p and "NestedLoopJoin" not in p


def test_snapshot_cycle_has_no_pair_enumeration(spark, sf):
    with no_broadcast(spark):
        p = plan(QS.scd2_one_pass(spark, sf))
    assert "NestedLoopJoin" not in p and "CartesianProduct" not in p
    assert "ArrowEvalPython" not in p
