"""Projects: declared sources, a graph of models, and how each is materialized.

A model is a function ``ctx -> DataFrame`` (or SQL text whose ``{name}``
placeholders are bound to upstream DataFrames by ``spark.sql``'s own
formatting).  ``ctx.ref`` builds upstream models on first use, so the run
order is the dependency order and a shared upstream (a diamond) is built once
per run.  The logical plan of the whole chain is one Catalyst plan until a
materialization writes it.

Materializations (K1-K6):

* ``view``          temp view over the plan; consumers read the view.
* ``ephemeral``     nothing stored; consumers inline the plan.
* ``table``         written as a new version; consumers read the stored files.
* ``materialized_view`` a table plus refresh time; rebuilt when stale.  An
                    ``aggregate_view`` takes in what its input gained and
                    lost since its last refresh instead.
* ``incremental``   first run builds the table, later runs apply a strategy
                    to the (high-water filtered) result.
"""

from __future__ import annotations

import datetime as _dt
import json
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.operators import strategies
from stratum.operators.maintain import MergeableAggregate
from stratum.plans.increment import ON_SCHEMA_CHANGE, apply_increment
from stratum.plans.store import Entry, TableStore, bare_path

if TYPE_CHECKING:
    from stratum.plans.snapshots import SnapshotTable

MATERIALIZATIONS = ("view", "table", "materialized_view", "ephemeral", "incremental")
STORED = ("table", "materialized_view", "incremental")
INCREMENTAL_STRATEGIES = ("merge", "delete+insert", "append", "insert_only")


class ProjectError(ValueError):
    pass


@dataclass
class ModelConfig:
    materialized: str = "table"
    unique_key: list[str] | None = None
    incremental_strategy: str = "merge"
    partition_by: object | None = None       # stratum.operators.layout.Partitioning
    cluster_by: list[str] | None = None
    require_partition_filter: bool = False
    full_replace: bool = False               # K6: keep schema/layout, replace rows
    enable_refresh: bool | None = None
    refresh_interval: _dt.timedelta | None = None
    max_staleness: _dt.timedelta | None = None
    partition_expiration_days: float | None = None   # K14, needs partition_by
    expiration_time: _dt.datetime | None = None      # K14, whole table
    deletion_protection: bool = False
    max_bytes_billed: int | None = None
    on_duplicate: str = "error"
    order_by: str | None = None              # for on_duplicate='last' | 'newest'
    # Incremental models whose result gains a column: 'fail', or 'append' to
    # add it to the table (metadata only, old rows read NULL).
    on_schema_change: str = "fail"
    # Partitioned incremental models: True asserts a key never moves to
    # another partition, which skips the scan of the target's keys that
    # finds the old partition of a moved key.
    partition_keys_stable: bool = False
    description: str | None = None
    column_comments: dict[str, str] = field(default_factory=dict)
    # E9 at build time: the declared output schema (stratum.types.Field).
    # Checked against the plan's schema before anything runs (metadata only);
    # REQUIRED columns are enforced inside the write itself, and a unique_key
    # between write and commit: a model that breaks it leaves the old version.
    contract: list | None = None

    def validate(self, name: str) -> None:
        if self.materialized not in MATERIALIZATIONS:
            raise ProjectError(f"model {name!r}: materialized must be one of {MATERIALIZATIONS}")
        if self.materialized == "incremental":
            if self.incremental_strategy not in INCREMENTAL_STRATEGIES:
                raise ProjectError(f"model {name!r}: incremental_strategy must be one of "
                                   f"{INCREMENTAL_STRATEGIES}")
            if self.incremental_strategy != "append" and not self.unique_key:
                raise ProjectError(f"model {name!r}: incremental strategy "
                                   f"{self.incremental_strategy!r} needs unique_key")
        if self.on_duplicate in ("last", "newest") and not self.order_by:
            raise ProjectError(f"model {name!r}: on_duplicate={self.on_duplicate!r} needs order_by")
        if self.on_schema_change not in ON_SCHEMA_CHANGE:
            raise ProjectError(f"model {name!r}: on_schema_change must be one of {ON_SCHEMA_CHANGE}")
        if self.cluster_by and len(self.cluster_by) > 4:
            raise ProjectError(f"model {name!r}: cluster_by takes at most 4 columns")
        if self.require_partition_filter and self.partition_by is None:
            raise ProjectError(f"model {name!r}: require_partition_filter needs partition_by")
        if self.partition_expiration_days is not None and self.partition_by is None:
            raise ProjectError(f"model {name!r}: partition_expiration_days needs partition_by")
        if self.enable_refresh and self.materialized != "materialized_view":
            raise ProjectError(f"model {name!r}: enable_refresh is only valid for "
                               "materialized_view")
        if self.refresh_interval is not None and not self.enable_refresh:
            raise ProjectError(f"model {name!r}: refresh_interval needs enable_refresh=True")
        if self.deletion_protection and self.expiration_time is not None:
            raise ProjectError(f"model {name!r}: deletion_protection cannot be used with "
                               "expiration_time")


@dataclass
class Model:
    name: str
    build: Callable[["Context"], DataFrame]
    config: ModelConfig
    maintained: "Maintained | None" = None


@dataclass
class Maintained:
    """An aggregate over ``rows`` of a stored model."""
    upstream: str
    aggregate: MergeableAggregate
    rows: Callable[["Context", DataFrame], DataFrame]


class Context:
    """What a model body sees while it is built."""

    def __init__(self, project: "Project", model: Model, incremental: bool):
        self.project = project
        self.model = model
        self._incremental = incremental

    @property
    def spark(self) -> SparkSession:
        return self.project.spark

    def ref(self, name: str, partition_filter=None) -> DataFrame:
        """S2.  A stored model flagged ``require_partition_filter`` must be
        referenced with a ``partition_filter`` on its partition column, or one
        that bounds the field it is partitioned by (P7).  Folders that cannot
        hold rows of the filter are not read, whichever columns it is on."""
        return self.project.ref(name, _from=self.model.name, partition_filter=partition_filter)

    def source(self, group: str, table: str) -> DataFrame:
        self.project.source_edges.add((self.model.name, group, table))
        return self.project.source(group, table)

    def var(self, name: str, default=None):
        return self.project.var(name, default)

    def is_incremental(self) -> bool:
        """True on a run that applies a strategy to an existing table."""
        return self._incremental

    @property
    def this(self) -> DataFrame:
        """The model's own stored table."""
        return self.project.store.read(self.model.name)

    def high_water(self, df: DataFrame, column: str) -> DataFrame:
        """On incremental runs keep rows newer than the stored maximum.

        The maximum comes from the table's statistics, which were taken when
        its folders were written: no stored row is read, and the filter is a
        literal that reaches the parquet scan of ``df``.
        """
        if not self._incremental:
            return df
        hw = self.project.store.bound(self.model.name, column)
        return df.filter(hw.isNull() | (F.col(column) > hw))


class Project:
    """``default_partition_expiration_days`` and ``default_table_expiration``
    are the dataset defaults, used by models that set no expiry."""

    def __init__(self, spark: SparkSession, store: TableStore | None = None,
                 vars: dict | None = None, default_partition_expiration_days: float | None = None,
                 default_table_expiration: _dt.timedelta | None = None):
        self.spark = spark
        self.store = store or TableStore(spark)
        self.vars = dict(vars or {})
        self.default_partition_expiration_days = default_partition_expiration_days
        self.default_table_expiration = default_table_expiration
        self.edges: set[tuple[str, str]] = set()   # (consumer, upstream) seen by ref()
        self.snapshots: dict[str, "SnapshotTable"] = {}
        self.source_edges: set[tuple[str, str, str]] = set()   # (consumer, group, table)
        self.sources: dict[str, dict[str, Callable[[], DataFrame]]] = {}
        self.models: dict[str, Model] = {}
        self._built: dict[str, DataFrame] = {}
        self._building: list[str] = []
        self._run_ts: _dt.datetime | None = None

    # -- declarations -----------------------------------------------------
    def add_source(self, group: str, tables: dict) -> "Project":
        """Tables given as a path, a DataFrame or a zero-arg callable."""
        g = self.sources.setdefault(group, {})
        for name, t in tables.items():
            if isinstance(t, DataFrame):
                g[name] = (lambda d=t: d)
            elif isinstance(t, str):
                g[name] = (lambda p=t: self.spark.read.parquet(p))
            elif callable(t):
                g[name] = t
            else:
                raise ProjectError(f"source {group}.{name}: unsupported {type(t).__name__}")
        return self

    def model(self, name: str, build=None, **config):
        """Declare a model; usable as ``@project.model("name", materialized=...)``."""
        def register(fn):
            cfg = ModelConfig(**config)
            if isinstance(cfg.unique_key, str):
                cfg.unique_key = [cfg.unique_key]
            cfg.validate(name)
            if name in self.models:
                raise ProjectError(f"model {name!r} declared twice")
            self.models[name] = Model(name, fn, cfg)
            return fn
        if build is not None:
            register(build)
            return self
        return register

    def sql_model(self, name: str, sql: str, refs: list[str] = (),
                  sources: dict[str, tuple[str, str]] | None = None, **config) -> "Project":
        """A SQL model: ``{x}`` placeholders bind to ``ref(x)`` or a declared source."""
        refs = list(refs)
        sources = dict(sources or {})
        # Known before any run, so that drop safety holds from the start.
        self.edges.update((name, r) for r in refs)

        def build(ctx: Context) -> DataFrame:
            frames = {r: ctx.ref(r) for r in refs}
            frames.update({k: ctx.source(*v) for k, v in sources.items()})
            if ctx.is_incremental():
                frames["this"] = ctx.this
            try:
                return ctx.spark.sql(sql, args=self._sql_args(), **frames)
            except KeyError as e:
                raise ProjectError(
                    f"model {name!r} uses {{{e.args[0]}}} but it is not wired: declare it in "
                    f"refs or sources (wired: {sorted(frames)}; models: {sorted(self.models)})"
                ) from None

        return self.model(name, build, **config)

    def aggregate_view(self, name: str, upstream: str, keys: list[str], measures: dict,
                       rows: Callable[[Context, DataFrame], DataFrame] | None = None, **config) -> "Project":
        """K3: a materialized view ``SELECT keys, measures FROM rows(upstream) GROUP BY keys``
        that is maintained: a refresh reads only the folders and files that the
        stored model ``upstream`` gained, or lost, since the last one.

        ``measures`` maps names to ``(kind, value)``, see ``operators.maintain``.
        ``rows`` prepares upstream rows (filter, columns, joins with other models).
        It must treat rows by themselves, so that the rows of a part of the input
        are the part's rows.  The view is built whole when that is not known to
        give the same: another model it reads has a new version, or it reads
        sources directly; upstream's columns or the definition have changed; rows
        were lost that the measures cannot take back; or the version of the last
        refresh is no longer kept."""
        aggregate = MergeableAggregate(keys, measures)
        prepared = rows or (lambda ctx, df: df)
        config = {"materialized": "materialized_view"} | config
        if config["materialized"] != "materialized_view" or config.get("partition_by") is not None:
            raise ProjectError(f"model {name!r}: a maintained aggregate is a materialized_view without partitions")
        self.model(name, lambda ctx: aggregate.finished(aggregate.state(prepared(ctx, ctx.ref(upstream)))), **config)
        self.models[name].maintained = Maintained(upstream, aggregate, prepared)
        self.edges.add((name, upstream))
        return self

    def _sql_args(self) -> dict:
        return {k: v for k, v in self.vars.items()
                if isinstance(v, (int, float, str, bool, _dt.date, _dt.datetime))}

    # -- lookups ----------------------------------------------------------
    def source(self, group: str, table: str) -> DataFrame:
        if group not in self.sources:
            raise ProjectError(f"unknown source group {group!r}; declared groups: "
                               f"{sorted(self.sources)}")
        if table not in self.sources[group]:
            raise ProjectError(f"source {group!r} has no table {table!r}; declared: "
                               f"{sorted(self.sources[group])}")
        return self.sources[group][table]()

    def var(self, name: str, default=None):
        """A project variable; unknown names list the known ones."""
        if name in self.vars:
            return self.vars[name]
        if default is not None:
            return default
        raise ProjectError(f"unknown var {name!r}; known vars: {sorted(self.vars)}")

    def ref(self, name: str, _from: str | None = None, partition_filter=None) -> DataFrame:
        """The result of another model (plan if ephemeral, else stored)."""
        df = self._ref(name, _from)
        cfg = self.models[name].config
        # Building the model itself (run) is not a read; a consumer's ref is.
        if _from is not None and cfg.materialized in STORED and (cfg.require_partition_filter or partition_filter is not None):
            return self._shown(self.models[name], self.store.scan(name, partition_filter))
        return df.filter(partition_filter) if partition_filter is not None else df

    def _ref(self, name: str, _from: str | None = None) -> DataFrame:
        if name not in self.models:
            who = f" (referenced by {_from!r})" if _from else ""
            raise ProjectError(f"unknown model {name!r}{who}; models: {sorted(self.models)}")
        if _from is not None:
            self.edges.add((_from, name))
        if name in self._built:
            return self._built[name]
        if name in self._building:
            cycle = " -> ".join(self._building[self._building.index(name):] + [name])
            raise ProjectError(f"dependency cycle: {cycle}")
        self._building.append(name)
        try:
            df = self._materialize(self.models[name])
        finally:
            self._building.pop()
        self._built[name] = df
        return df

    # -- running ----------------------------------------------------------
    def run(self, select: list[str] | None = None, run_ts: _dt.datetime | None = None,
            fresh: bool = True) -> dict[str, DataFrame]:
        """Build the selected models (default: all) in dependency order."""
        if fresh:
            self._built = {}
        self._run_ts = run_ts
        names = select or list(self.models)
        return {n: self.ref(n) for n in names}

    def _materialize(self, m: Model) -> DataFrame:
        from stratum.operators import layout
        cfg = m.config
        kind = cfg.materialized
        existing = self.store.exists(m.name)
        incremental = kind == "incremental" and existing
        if kind == "materialized_view" and existing and not self._stale(m):
            return self._shown(m, self.store.read(m.name))   # fresh: nothing upstream is built
        ctx = Context(self, m, incremental)
        extra = {}
        if m.maintained:
            if self._ref(m.maintained.upstream, m.name) is not None and existing:
                done = self._maintain(m, ctx)
                if done is not None:
                    return done
        df = m.build(ctx)
        if m.maintained:
            extra = {"maintained": json.dumps(self._inputs(m))}
        if cfg.contract:
            df = self._enforce_contract(m, df)
        if cfg.max_bytes_billed:
            from stratum.operators.stats import enforce_byte_cap
            enforce_byte_cap(df, cfg.max_bytes_billed, m.name)
        if kind == "ephemeral":
            return df
        if kind == "view":
            view = f"{self.store.database}__{m.name}"
            df.createOrReplaceTempView(view)
            return self.spark.table(view)
        part_cols: list[str] = []
        if cfg.partition_by is not None:
            df, part_cols = layout.apply_partitioning(df, cfg.partition_by, self._run_ts)
        if incremental:
            return self._expire(m, apply_increment(
                self.store, m.name, df, cfg.incremental_strategy, cfg.unique_key,
                cfg.on_duplicate, cfg.order_by, cfg.partition_keys_stable, cfg.on_schema_change,
                self._run_ts, unique=bool(cfg.contract)))
        if kind == "table" and cfg.full_replace and existing:
            df = strategies.full_replace(self.store.read(m.name), df)
        out = self.store.write(m.name, df, partition_by=part_cols or None,
                               cluster_by=cfg.cluster_by,
                               require_partition_filter=cfg.require_partition_filter,
                               column_comments=cfg.column_comments,
                               refreshed_at=self._run_ts,
                               extra=layout.described(cfg.partition_by) | extra,
                               unique_key=cfg.unique_key if cfg.contract else None,
                               required=[f.name for f in cfg.contract or [] if f.mode == "REQUIRED" and f.alter != "insert"])
        return self._shown(m, self._expire(m, out))

    # -- maintained aggregates (K3) ------------------------------------------
    def _shown(self, m: Model, df: DataFrame) -> DataFrame:
        return df.select(*m.maintained.aggregate.columns) if m.maintained else df

    def _inputs(self, m: Model) -> dict:
        """What a maintained view was computed from: the version of its upstream
        and of the other stored models it reads, and whether it reads anything
        that has no versions."""
        d = m.maintained
        if self.models[d.upstream].config.materialized not in STORED:
            raise ProjectError(f"model {m.name!r}: its upstream {d.upstream!r} must be a stored model")
        others, todo, seen, unversioned = {}, [m.name], set(), False
        while todo:
            name = todo.pop()
            seen.add(name)
            unversioned |= any(c == name for c, _, _ in self.source_edges)
            for u in {u for c, u in self.edges if c == name} - seen - {d.upstream}:
                if self.models[u].config.materialized in STORED:
                    others[u] = self.store.info(u)["version"]
                else:
                    todo.append(u)
        info = self.store.info(d.upstream)
        return {"version": info["version"], "schema": info["schema"], "others": others,
                "unversioned": unversioned, "definition": d.aggregate.described()}

    def _maintain(self, m: Model, ctx: Context) -> DataFrame | None:
        """The view with what its upstream gained and lost merged in; None if it must be built whole."""
        d, store = m.maintained, self.store
        before = json.loads(store.property(m.name, "maintained") or "{}")
        # Planned on no rows, so that the models it reads are built and known.
        d.rows(ctx, store.read(d.upstream).limit(0))
        now = self._inputs(m)
        if now["unversioned"] or {k: v for k, v in before.items() if k != "version"} != {k: v for k, v in now.items() if k != "version"}:
            return None
        if before["version"] not in store.kept_versions(d.upstream):
            return None
        gained, lost = self._changes(d.upstream, before["version"])
        if not gained and not lost:
            store.touch(m.name, self._run_ts, {"maintained": json.dumps(now)})
            return self._shown(m, store.read(m.name))
        info = store.info(d.upstream)
        part = lambda entries: d.aggregate.state(d.rows(ctx, store.read_entries(d.upstream, info, entries)))
        states = [d.aggregate.unfinished(store.read(m.name)), part(gained)]
        if lost:
            if not d.aggregate.retractable(states[1]):
                return None
            states.append(d.aggregate.negated(part(lost)))
        out = store.write(m.name, d.aggregate.finished(d.aggregate.merged(states)), cluster_by=m.config.cluster_by,
                          column_comments=m.config.column_comments, refreshed_at=self._run_ts,
                          extra={"maintained": json.dumps(now)})
        return self._shown(m, out)

    def _changes(self, name: str, version: int) -> tuple[list[Entry], list[Entry]]:
        """The folders and files that a stored model has and ``version`` lacked, and the other way round."""
        old, new = ({(bare_path(e.path), e.proj): e for e in self.store.entries(name, v)} for v in (version, None))
        only_new, only_old = [e for k, e in new.items() if k not in old], [e for k, e in old.items() if k not in new]
        # A merge replaces some files of a folder: what is left of it is in both.
        files = lambda entries: {bare_path(f): Entry(e.part, f, e.proj) for e in entries for f in self.store.files(name, e)}
        shared = {bare_path(e.path).rsplit("/", 1)[0] for e in only_new if e.path.endswith(".parquet")}
        split = [e for e in only_old if bare_path(e.path) in shared or e.path.endswith(".parquet")]
        mine = files(e for e in only_new if e.path.endswith(".parquet"))
        theirs = files(split)
        gained = [e for e in only_new if not e.path.endswith(".parquet")] + [e for k, e in mine.items() if k not in theirs]
        lost = [e for e in only_old if e not in split] + [e for k, e in theirs.items() if k not in mine]
        return gained, lost

    def _now(self) -> _dt.datetime:
        return self._run_ts or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)

    def _expire(self, m: Model, out: DataFrame) -> DataFrame:
        """K14 after a write: drop partitions past the model's, its
        partitioning's or the dataset's default expiry -- a manifest edit, no
        rewrite.  Only time partitions grow old; integer ranges never expire."""
        from stratum.operators.layout import TimePartitioning
        spec = m.config.partition_by
        if not isinstance(spec, TimePartitioning):
            return out
        days = next((d for d in (m.config.partition_expiration_days, spec.expiration_days,
                                 self.default_partition_expiration_days) if d is not None), None)
        if days is None:
            return out
        return self.store.expire_partitions(m.name, days, self._now())

    def expire_tables(self, as_of: _dt.datetime | None = None) -> list[str]:
        """K14 for whole tables: forget stored models past their expiry time
        (or the dataset default counted from the first build) unless
        deletion-protected.  Returns the expired names; their files stay."""
        from stratum.operators.layout import table_expired
        as_of = as_of or self._now()
        gone = []
        for name, m in self.models.items():
            cfg = m.config
            if not self.store.exists(name) or cfg.deletion_protection:
                continue
            when = cfg.expiration_time
            if when is None and self.default_table_expiration is not None:
                created = self.store.property(name, "created_at")
                if created:
                    when = _dt.datetime.fromisoformat(created) + self.default_table_expiration
            if table_expired(when, as_of):
                self.store.drop(name)
                self._built.pop(name, None)
                gone.append(name)
        return gone

    def snapshot(self, name: str, upstream: str, unique_key: str, updated_at: str, **options) -> "SnapshotTable":
        """Declare a snapshot of a model.  It is a consumer of the model from then
        on, so that its key and version column cannot be dropped there."""
        from stratum.plans.snapshots import SnapshotTable
        if name in self.models or name in self.snapshots:
            raise ProjectError(f"{name!r} declared twice")
        self.snapshots[name] = SnapshotTable(self.store, name, unique_key, updated_at, **options)
        self.edges.add((name, upstream))
        return self.snapshots[name]

    def run_snapshot(self, name: str, run_ts) -> DataFrame:
        """One run of a declared snapshot over its model as it is now."""
        upstream = next(u for c, u in self.edges if c == name)
        return self.snapshots[name].run(self.ref(upstream, _from=name), run_ts)

    def consumers(self, name: str) -> list[str]:
        """Models that read ``name`` through ref() in this project's runs, and snapshots of it."""
        return sorted({c for c, u in self.edges if u == name})

    def evolve_table(self, name: str, fields: list, backfill: bool = False) -> DataFrame:
        """E1-E5 on a stored model, as a new version that changes metadata
        only (no data is rewritten).  A drop is refused when the model itself or a consumer uses the
        column as unique key, partition or cluster column (E2)."""
        from stratum.operators import evolve
        from stratum.types import validate_fields
        df = self.store.read(name)
        validate_fields(fields, existing=df.columns)
        plan = evolve.plan(df, fields)
        if plan.empty:
            return df
        roles = []
        for who in [name] + self.consumers(name):
            if who in self.models:
                c = self.models[who].config
                roles.append({"name": who, "unique_key": c.unique_key or [],
                              "cluster_by": c.cluster_by or [],
                              "partition_by": [getattr(c.partition_by, "field", None)]
                              if getattr(c.partition_by, "field", None) else []})
            elif who in self.snapshots:
                s = self.snapshots[who]
                roles.append({"name": who, "unique_key": [s.key], "version_column": [s.updated_at]})
        evolve.check_drop_safety(plan.drops, roles)
        # A metadata change: no data file is rewritten (TableStore.evolve).
        return self.store.evolve(name, fields, backfill)

    def _enforce_contract(self, m: Model, df: DataFrame) -> DataFrame:
        """Refuse a model whose output schema breaks its contract: an
        undeclared column, a missing one (REPEATED exempt), a type mismatch,
        or a unique key / partition / cluster column that does not exist.
        Columns being added (``alter='insert'``) are skipped."""
        from stratum.operators.contracts import enforce_required
        from stratum.types import declared_type
        cfg = m.config
        declared = [f for f in cfg.contract if f.alter != "insert"]
        names = {f.name.lower() for f in cfg.contract}
        actual = {f.name.lower(): f for f in df.schema}
        problems = [f"undeclared column {a.name!r}" for a in df.schema
                    if a.name.lower() not in names]
        for f in declared:
            a = actual.get(f.name.lower())
            if a is None:
                if not f.repeated:
                    problems.append(f"missing column {f.name!r}")
            elif declared_type(a) != f.canonical:
                problems.append(f"column {f.name!r} is {declared_type(a)}, "
                                f"declared {f.canonical}")
        part = getattr(cfg.partition_by, "field", None)
        for role, cols in (("unique key", cfg.unique_key), ("cluster", cfg.cluster_by),
                           ("partition", [part] if part else [])):
            problems += [f"{role} column {c!r} is not in the output"
                         for c in cols or [] if c.lower() not in actual]
        if problems:
            raise ProjectError(f"model {m.name!r} breaks its contract: " + "; ".join(problems))
        return enforce_required(df, declared)

    def _stale(self, m: Model) -> bool:
        """K3: rebuild when the refresh interval has passed, or when the stored
        result is older than readers accept (whichever comes first)."""
        cfg = m.config
        limit = min((x for x in (cfg.refresh_interval, cfg.max_staleness) if x is not None), default=None)
        if limit is None:
            return True
        last = _dt.datetime.fromisoformat(self.store.info(m.name)["refreshed_at"])
        now = self._run_ts or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        return now - last >= limit
