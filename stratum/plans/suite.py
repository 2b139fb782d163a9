"""Registry of the operator queries: one Spark query per SURVEY section 2 key,
and where possible the DuckDB SQL that computes the same result from the same
parquet tables.  ``__spark_entry__`` exposes both.

Column names are aliased identically on both sides; money is summed as
DECIMAL and cast to DOUBLE; ``run_ts`` and other clocks are fixed literals.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    # Importing the modules registers their queries.
    from stratum.plans import (q_core, q_incremental, q_snapshot, q_schema,  # noqa: F401
                               q_layout, q_io, q_routines, q_stream, q_maintained)
