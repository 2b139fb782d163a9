"""One increment applied to a stored table: what an incremental model's run
and every micro-batch of a stream have in common.

The increment is evaluated once: it is cut with a reliable checkpoint before
any strategy reads it, because each strategy reads it more than once and a
JDBC, clock or random column could differ between the reads.

A partitioned table has only the touched partitions rewritten: those that hold
increment rows and, for key strategies, those that hold target rows with the
increment's keys.  An append to any table only adds files, and so does inserting
rows with new keys.

Merge and delete+insert on an unpartitioned table rewrite only touched files:
plain parquet has no row-level update, but a file without any of the increment's
keys stays as it is.  A semi join of the target's keys (no other column is read)
with the increment's finds the files; the least and greatest key of the
increment bound that scan, so files of a clustered table are skipped by their
own minima and maxima.  The rows of the touched files and the increment go
through the same strategies as whole tables do.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.operators import strategies
from stratum.plans.store import Entry, TableStore, bare_path, partition_part
from stratum.session import checkpoint
from stratum.types import Field, canonical_of

ON_SCHEMA_CHANGE = ("fail", "append")


def add_new_columns(store: TableStore, name: str, source: DataFrame) -> None:
    """Add the columns that ``source`` has and the table lacks (metadata only; old rows read NULL)."""
    new = strategies.extra_columns(source, store.read(name))
    if new:
        store.evolve(name, [Field(c, canonical_of(t), "REPEATED" if isinstance(t, T.ArrayType) else "NULLABLE",
                                  alter="insert") for c in new for t in [source.schema[c].dataType]])


def apply_increment(store: TableStore, name: str, source: DataFrame, strategy: str, key=None,
                    on_duplicate: str = "error", order_by: str | None = None,
                    keys_stable: bool = False, on_schema_change: str = "fail",
                    refreshed_at: _dt.datetime | None = None,
                    extra: dict | None = None, unique: bool = False) -> DataFrame:
    """Apply ``source`` (with the derived partition column, if the table has
    one) to the stored table and commit the next version; ``extra`` properties
    are part of the same commit."""
    s = checkpoint(source)
    if on_schema_change == "append":
        add_new_columns(store, name, s)
    info = store.info(name)
    if strategy == "append":
        return store.append_rows(name, s, refreshed_at, extra)
    kw = {"on_duplicate": on_duplicate, "order_by": order_by} if strategy == "merge" else {}
    if not info["partition_by"]:
        target = store.read(name)
        keys = strategies._resolve_keys(target, [key] if isinstance(key, str) else list(key))
        check = keys if unique else None
        if strategy == "insert_only" or (strategy == "merge" and {c.lower() for c in target.columns} <= {k.lower() for k in keys}):
            return store.replace_entries(name, info, store.entries(name), strategies.new_rows(target, s, keys),
                                         refreshed_at, extra, check)
        rows, kept = _touched(store, name, info, s, keys)
        return store.replace_entries(name, info, kept, strategies.apply_strategy(strategy, rows, s, keys, **kw),
                                     refreshed_at, extra, check)
    part_col = info["partition_by"][0]
    keys = [key] if isinstance(key, str) else list(key)
    touched = s.select(partition_part(part_col).alias("part"))
    if not keys_stable:
        t_keys = store.read(name).select(*keys, partition_part(part_col).alias("part"))
        touched = touched.unionByName(
            t_keys.join(s.select(*keys).distinct(), keys, "left_semi").select("part"))
    # One row per touched partition: bounded by the partition count.
    parts = [r["part"] for r in touched.distinct().collect()]
    new = strategies.apply_strategy(strategy, store.read_partitions(name, parts), s, keys, **kw)
    return store.replace_partitions(name, new, parts, refreshed_at, extra, keys if unique else None)


FILE = "__file"


def _touched(store: TableStore, name: str, info: dict, s: DataFrame, keys: list[str]) -> tuple[DataFrame, list[Entry]]:
    """The rows of the files that hold any of the increment's keys, and what stays of the table besides."""
    entries = store.entries(name)
    rows = store.read_entries(name, info, entries, file_col=FILE)
    have = {c.lower(): c for c in s.columns}
    wanted = s.select(*[F.col(f"`{have[k.lower()]}`").cast(rows.schema[k].dataType).alias(k) for k in keys]).dropna().distinct()
    for k in keys:
        ends = wanted.agg(F.min(k).alias("low"), F.max(k).alias("high"))
        rows = rows.filter(F.col(k).between(ends.select("low").scalar(), ends.select("high").scalar()))
    found = rows.select(*keys, FILE).join(wanted, keys, "left_semi").select(FILE).distinct()
    files = {bare_path(r[FILE]) for r in found.collect()}   # at most one row a file of the table
    touched, kept = [], []
    for e in entries:
        inside = [e.path] if bare_path(e.path) in files else []
        if not inside and not any(f.startswith(bare_path(e.path) + "/") for f in files):
            kept.append(e)
            continue
        for f in inside or store.files(name, e):
            # What is left of a folder: its statistics are those of the folder no longer.
            (touched if bare_path(f) in files else kept).append(replace(e, path=f, stats=None))
    return store.read_entries(name, info, touched), kept
