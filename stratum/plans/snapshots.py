"""Stored SCD2 snapshots (N5, N8) with append-only history.

Layout of one snapshot: a single parquet dataset partitioned by run version
``v`` and row state ``_state`` (and, with ``auto_optimize``, by the day of
``dbt_valid_from``), files clustered by the key::

    <root>/<name>/g=<generation>/__version=<n>/__write=<id>/_state=open/...     open rows after run n
    <root>/<name>/g=<generation>/__version=<n>/__write=<id>/_state=closed/...   rows closed by run n

Run n+1 reads only the open rows of run n (about one per key) plus the source,
and writes ``__version=n+1``; closed history is never rewritten.

The committed version lives in the catalog pointer, with an index of its
folders: for each, the state of its rows and the bounds of their validity
(from the statistics of what each run wrote).  Readers list the folders of the
index alone: ``open_rows`` those of open rows, ``as_of`` those whose interval
can hold the time asked for.  A failed run, or one that lost to another writer,
leaves a folder of its own that no index names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.functions.util import ts_literal
from stratum.operators import profile
from stratum.operators import snapshot as scd
from stratum.operators.layout import TIME_PARTITION_COLUMN, time_bucket
from stratum.plans.store import Entry, TableStore, decoded_path

STATE = "_state"
VERSION, WRITE = "__version", "__write"   # no column of a source is called so
OPEN, CLOSED = "open", "closed"


class SnapshotConfigChanged(ValueError):
    pass


class SnapshotTable:
    """A stored snapshot.  Changing the key, the version column, the
    strategy or the layout of an existing snapshot starts a new generation
    (a fresh history in its own folder; the old one stays on disk) when
    ``replace_on_change`` is set, and is an error otherwise."""

    STRATEGY = "timestamp"

    def __init__(self, store: TableStore, name: str, unique_key: str, updated_at: str,
                 hard_deletes: bool = False, auto_optimize: bool = True,
                 ts_type: str = "timestamp", replace_on_change: bool = False):
        self.store = store
        self.name = name
        self.key = unique_key
        self.updated_at = updated_at
        self.hard_deletes = hard_deletes
        self.auto_optimize = auto_optimize
        self.ts_type = ts_type
        self.replace_on_change = replace_on_change
        self.config = json.dumps({"unique_key": unique_key, "updated_at": updated_at,
                                  "strategy": self.STRATEGY, "auto_optimize": auto_optimize},
                                 sort_keys=True)

    @property
    def generation(self) -> int:
        g = self.store.property(self.name, "snapshot_generation")
        return int(g) if g else 1

    @property
    def base(self) -> str:
        return f"{self.store.root}/{self.name}/g={self.generation}"

    def version(self) -> int:
        return self.store.info(self.name)["version"] if self.store.exists(self.name) else 0

    def _check_config(self) -> int:
        """Generation to write into: the current one, or the next after a
        configuration change."""
        stored = self.store.property(self.name, "snapshot_config")
        if stored is None or stored == self.config:
            return self.generation
        if not self.replace_on_change:
            raise SnapshotConfigChanged(
                f"snapshot {self.name!r} was built with {stored}, now {self.config}; "
                "pass replace_on_change=True to start a new snapshot")
        return self.generation + 1

    def _dataset(self) -> DataFrame:
        r = self.store.spark.read.option("basePath", self.base)
        recorded = self.store.property(self.name, "snapshot_schema")
        if recorded:
            # The latest schema covers every version (a column the source
            # gained reads as NULL in older files) and spares an inference job.
            r = r.schema(T.StructType.fromJson(json.loads(recorded)))
        return r.parquet(self.base)

    def _strip(self, df: DataFrame) -> DataFrame:
        return df.drop(VERSION, WRITE, STATE, TIME_PARTITION_COLUMN)

    def entries(self) -> list[Entry]:
        """The folders of the current version: ``part`` is the state of their rows."""
        path = self.store.property(self.name, "snapshot_index")
        return self.store._manifest(path) if path else []

    def _of(self, entries: list[Entry]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(self.store.property(self.name, "snapshot_schema")))
        if not entries:
            return self._strip(self.store.spark.createDataFrame([], schema))
        # The latest schema covers every version: a column the source gained reads as NULL in older files.
        r = self.store.spark.read.option("basePath", self.base).schema(schema)
        return self._strip(r.parquet(*[e.path for e in entries]))

    def read(self) -> DataFrame:
        """The whole snapshot: all closed history plus the current open rows."""
        return self._of(self.entries())

    def open_rows(self) -> DataFrame:
        return self._of([e for e in self.entries() if e.part == OPEN])

    def as_of(self, when) -> DataFrame:
        """The versions that were valid at a time: from ``dbt_valid_from`` on, up to but not at ``dbt_valid_to``.
        Folders whose validity cannot hold the time are neither listed nor read."""
        at = ts_literal(when, self.ts_type)
        dt = T.TimestampNTZType() if self.ts_type == "timestamp_ntz" else T.TimestampType()
        text = self.store.spark.range(1).select(profile.encoded(at, dt)).first()[0]
        return self._of(self._entries_at(int(text))).filter(
            (F.col(scd.VALID_FROM) <= at) & (F.col(scd.VALID_TO).isNull() | (F.col(scd.VALID_TO) > at)))

    def _entries_at(self, micros: int) -> list[Entry]:
        def can(e: Entry) -> bool:
            p = e.profile()
            start, end = p.columns[scd.VALID_FROM], p.columns[scd.VALID_TO]
            return (start.low is None or int(start.low) <= micros) and (end.nulls > 0 or end.high is None or int(end.high) > micros)
        return [e for e in self.entries() if can(e)]

    def run(self, source: DataFrame, run_ts) -> DataFrame:
        gen = self._check_config()
        before = self.version()
        n = before if gen == self.generation else 0
        if n == 0:
            rows = scd.initial(source, self.key, self.updated_at, run_ts, self.ts_type)
        else:
            rows = scd.cycle_open(self.open_rows(), source, self.key, self.updated_at, run_ts,
                                  self.hard_deletes, self.ts_type)
        self._write(rows, n + 1, gen, before)
        return self.read()

    def run_changes(self, changes: DataFrame, run_ts=None, extra: dict | None = None) -> DataFrame:
        """A run over change rows with any number of versions per key (see
        ``snapshot.cycle_changes``); ``extra`` properties are committed with it."""
        gen = self._check_config()
        before = self.version()
        n = before if gen == self.generation else 0
        rows = scd.cycle_changes(self.open_rows() if n else None, changes, self.key,
                                 self.updated_at, run_ts, self.ts_type)
        self._write(rows, n + 1, gen, before, extra)
        return self.read()

    def _write(self, rows: DataFrame, version: int, gen: int, previous: int, extra: dict | None = None) -> None:
        out = rows.withColumn(STATE, F.when(F.col(scd.VALID_TO).isNull(), "open")
                              .otherwise("closed"))
        parts = [STATE]
        if self.auto_optimize:
            out = out.withColumn(TIME_PARTITION_COLUMN, time_bucket(F.col(scd.VALID_FROM), "DAY"))
            parts.append(TIME_PARTITION_COLUMN)
            # Files sorted by key (row-group statistics prune key lookups);
            # rebalance splits a hot partition day over several writers.
            out = (out.hint("rebalance", STATE, TIME_PARTITION_COLUMN)
                   .sortWithinPartitions(STATE, TIME_PARTITION_COLUMN, self.key))
        base = f"{self.store.root}/{self.name}/g={gen}"
        full = T.StructType(list(out.schema.fields)).add(VERSION, T.IntegerType())
        folder = f"{base}/{VERSION}={version}/{WRITE}={uuid.uuid4().hex[:8]}"
        out.write.partitionBy(*parts).parquet(folder)
        written = self.store.spark.read.option("basePath", base).schema(full).parquet(folder)
        path = F.regexp_extract(decoded_path(F.col("_metadata.file_path")), r"^(.*)/[^/]+$", 1)
        bounds = [scd.VALID_FROM, scd.VALID_TO]
        # Two columns of what this run wrote; one row a folder.
        found = written.groupBy(path.alias("__path")).agg(*profile.aggregates(written, bounds)).collect()
        new = [Entry(CLOSED if f"/{STATE}={CLOSED}" in r["__path"] else OPEN, r["__path"], None,
                     profile.from_row(written.schema, r, bounds).json()) for r in found]
        history = [e for e in self.entries() if e.part == CLOSED] if version > 1 else []
        self.store.point(self.name, base, version,
                         partition_by=[VERSION] + parts,
                         cluster_by=[self.key] if self.auto_optimize else [],
                         extra={"snapshot_config": self.config, "snapshot_generation": gen,
                                "snapshot_index": self.store._write_manifest(self.name, version, [*history, *new]),
                                "snapshot_schema": full.json()} | (extra or {}),
                         schema=full, previous=previous)
