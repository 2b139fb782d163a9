"""Print the physical plan facts that matter at scale for the headline
operators: exchanges, join strategies, pushed filters and read schemas.

    python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plans(spark, sf):
    from stratum.operators import evolve, snapshot as scd, strategies as S
    from stratum.plans import fixtures, q_core, q_incremental as QI, q_schema as QE
    from stratum.plans import q_snapshot as QS
    from stratum.plans.marts import revenue_by_region_month, revenue_project
    p = revenue_project(spark, sf)
    yield "mart_revenue (model body)", revenue_by_region_month(
        p.run(["int_enriched"])["int_enriched"], p.run(["stg_users"])["stg_users"])
    yield "merge_upsert", S.merge_upsert(QI._target(spark, sf), QI._source(spark, sf), "order_id",
                                         on_duplicate="keep")
    yield "merge_insert_only", S.merge_insert_only(QI._target(spark, sf), QI._source(spark, sf),
                                                   "order_id")
    yield "delete_insert", QI.delete_insert(spark, sf)
    yield "scd2 one-pass cycle", QS.scd2_one_pass(spark, sf)
    yield "evolve_combined", evolve.evolve(fixtures.raw_orders(spark, sf), QE.COMBINED)
    yield "agg_listagg", q_core.agg_listagg(spark, sf)
    yield "not_in_subquery", q_core.not_in_subquery(spark, sf)
    yield "schema_contract", QE.schema_contract(spark, sf)


def facts(text: str) -> dict:
    return {
        "shuffle exchanges": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|"
                                            r"Exchange SinglePartition", text)),
        "broadcast exchanges": text.count("BroadcastExchange"),
        "sort-merge joins": text.count("SortMergeJoin"),
        "broadcast hash joins": text.count("BroadcastHashJoin"),
        "nested-loop joins": text.count("NestedLoopJoin"),
        "python UDF nodes": len(re.findall(r"ArrowEvalPython|BatchEvalPython", text)),
        "pushed filters": sorted(set(re.findall(r"PushedFilters: \[([^\]]*)\]", text)))[:4],
        "read schemas": sorted(set(re.findall(r"ReadSchema: (struct<\S*)", text)))[:4],
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from stratum.session import get_spark
    spark = get_spark("local[8]", 8)
    # Plans as the optimizer writes them before runtime statistics (AQE
    # re-plans joins from measured sizes when the query runs).
    for name, df in plans(spark, sf):
        buf = io.StringIO()
        with redirect_stdout(buf):
            df.explain()
        print(f"## {name}")
        for k, v in facts(buf.getvalue()).items():
            print(f"- {k}: {v}")
        print()


if __name__ == "__main__":
    main()
