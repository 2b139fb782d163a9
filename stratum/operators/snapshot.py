"""SCD type 2 snapshots (N1-N7, J3, J4, P10) as pure DataFrame functions.

A snapshot table is the source's columns plus four bookkeeping columns.  One
run applies, in order: invalidate (close open versions for which the source
has a newer row), insert (new versions for new, changed or re-appearing
keys), and optionally hard delete (close open versions whose key left the
source).

``cycle_open`` does the three steps in one pass over the *open* rows only:

* the source is reduced to one row per key (max version time) with a
  partial aggregate -- a key holding a third of the source becomes one row
  per task before the shuffle;
* open rows are left-joined to that per-key table (both sides unique per
  key, so no row multiplication and no hot key);
* a row is closed if the source has a newer version (step 1) or, with hard
  deletes, if its key is NOT IN the source (step 3, SQL NULL semantics from
  two scalar facts of the source);
* after step 1 no surviving open row has a newer source row, so the insert
  condition of step 2 reduces to "no surviving open row for the key": an
  anti join of the source against the survivors' keys.

NULL keys never take part in a join: NULL-key open rows are never closed by
step 1 and NULL-key source rows are always inserted, exactly as the
reference's ``=`` comparisons behave, and they do not pile into one shuffle
partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions.helpers import SCD_ID_SEPARATOR
from stratum.functions.util import ts_literal

# The bookkeeping column names of a snapshot table.
SCD_ID = "dbt_scd_id"
UPDATED_AT = "dbt_updated_at"
VALID_FROM = "dbt_valid_from"
VALID_TO = "dbt_valid_to"
SCD_COLUMNS = (SCD_ID, UPDATED_AT, VALID_FROM, VALID_TO)


def scd_id(key: str, updated_at: str) -> Column:
    """Hex md5 of key, '|', version time (both as strings); NULL if a part is NULL."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(SCD_ID_SEPARATOR),
                          F.col(updated_at).cast("string")))


def _run(run_ts, ts_type: str) -> Column:
    return run_ts if isinstance(run_ts, Column) else ts_literal(run_ts, ts_type)


def _versions(source: DataFrame, key: str, updated_at: str, run: Column, ts_type: str) -> DataFrame:
    return source.select("*", scd_id(key, updated_at).alias(SCD_ID),
                         F.col(updated_at).alias(UPDATED_AT), run.alias(VALID_FROM),
                         F.lit(None).cast(ts_type).alias(VALID_TO))


def _data_columns(df: DataFrame) -> list[str]:
    scd = {c.lower() for c in SCD_COLUMNS}
    return [c for c in df.columns if c.lower() not in scd]


def initial(source: DataFrame, key: str, updated_at: str, run_ts,
            ts_type: str = "timestamp") -> DataFrame:
    """The first load -- every source row is an open version."""
    return _versions(source, key, updated_at, _run(run_ts, ts_type), ts_type)


def current_rows(snap: DataFrame) -> DataFrame:
    """P10: open versions only."""
    return snap.filter(F.col(VALID_TO).isNull())


def _list_facts(source: DataFrame, key: str) -> tuple[Column, Column]:
    """Row count and NULL-key count of the source, as one scalar subquery
    (a global aggregate: one row) used twice -- Spark evaluates it once."""
    facts = source.agg(F.struct(F.count(F.lit(1)).alias("n"),
                                F.count_if(F.col(key).isNull()).alias("nulls"))).scalar()
    return facts.getField("n"), facts.getField("nulls")


def _source_facts(source: DataFrame, key: str, updated_at: str) -> tuple[DataFrame, Column, Column]:
    per_key = (source.filter(F.col(key).isNotNull()).groupBy(key)
               .agg(F.max(updated_at).alias("__src_max"), F.lit(True).alias("__in_src")))
    n, nulls = _list_facts(source, key)
    return per_key, n, nulls


def newer_in_source(open_rows: DataFrame, source: DataFrame, key: str, updated_at: str) -> DataFrame:
    """Open rows for which the source has a row with the same key and a
    later version time (the correlated ``IN`` of the invalidate step), as a
    semi join on the per-key maximum."""
    per_key, _, _ = _source_facts(source, key, updated_at)
    # per_key is unique per key, so the inner join never multiplies rows.
    return (open_rows.join(per_key, key)
            .filter(F.col("__src_max") > F.col(UPDATED_AT))
            .drop("__src_max", "__in_src"))


def changed_or_new(source: DataFrame, open_rows: DataFrame, key: str, updated_at: str) -> DataFrame:
    """Source rows with no open version, or newer than the open version
    (LEFT JOIN on key with the residual theta predicate), before any
    invalidation -- the insert condition taken on its own."""
    o = open_rows.select(F.col(key).alias("__k"), F.col(UPDATED_AT).alias("__u"))
    j = source.join(o, source[key] == o["__k"], "left")
    return (j.filter(F.col("__k").isNull() | (F.col(updated_at) > F.col("__u")))
            .drop("__k", "__u"))


def cycle_open(open_rows: DataFrame, source: DataFrame, key: str, updated_at: str, run_ts,
               hard_deletes: bool = False, ts_type: str = "timestamp") -> DataFrame:
    """N2-N5 on the open rows: returns the open rows after the run (closed
    ones carry ``dbt_valid_to = run_ts``) plus the inserted versions."""
    run = _run(run_ts, ts_type)
    per_key, n_src, n_null = _source_facts(source, key, updated_at)

    keyed = open_rows.filter(F.col(key).isNotNull())
    null_keyed = open_rows.filter(F.col(key).isNull())

    j = keyed.join(per_key, key, "left")
    newer = F.coalesce(F.col("__src_max") > F.col(UPDATED_AT), F.lit(False))
    if hard_deletes:
        gone = (n_src == 0) | (F.col("__in_src").isNull() & (n_null == 0))
        null_gone = n_src == 0
    else:
        gone = F.lit(False)
        null_gone = F.lit(False)
    closed = newer | gone
    cols = open_rows.columns
    updated = (j.withColumn("__newer", newer)
               .withColumn(VALID_TO, F.when(closed, run).otherwise(F.col(VALID_TO))))
    kept_open = updated.filter(~F.col("__newer")).select(key)
    updated = updated.select(*cols)
    null_rows = null_keyed.withColumn(
        VALID_TO, F.when(null_gone, run).otherwise(F.col(VALID_TO))).select(*cols)

    src_keyed = source.filter(F.col(key).isNotNull())
    src_null = source.filter(F.col(key).isNull())
    new_src = src_keyed.join(kept_open, key, "left_anti").unionByName(src_null)
    inserted = _versions(new_src, key, updated_at, run, ts_type)
    return _union(_union(updated, null_rows), inserted)


def cycle_changes(open_rows: DataFrame | None, changes: DataFrame, key: str, updated_at: str,
                  run_ts=None, ts_type: str = "timestamp") -> DataFrame:
    """The open rows after a batch of change rows that may hold several
    versions of a key: each becomes a version, in the order of ``updated_at``,
    closed by the next; a row that is not newer than its key's open version is
    ignored.  ``open_rows`` is None before the first batch.

    With ``run_ts`` all versions of the batch open, and are closed, at that
    time.  Without it a version is valid from its own ``updated_at`` to the
    next one's, so that the result does not depend on how changes are cut into
    batches.  Rows that agree in key and ``updated_at`` are one version (the
    greatest row); NULL keys are always inserted.
    """
    def at(c):
        return _run(run_ts, ts_type) if run_ts is not None else c.cast(ts_type)

    others = [c for c in changes.columns if c not in (key, updated_at)]
    dated = changes.filter(F.col(key).isNotNull())
    if others:
        dated = (dated.groupBy(key, updated_at).agg(F.max(F.struct(*others)).alias("__row"))
                 .select(key, updated_at, "__row.*").select(*changes.columns))
    else:
        dated = dated.distinct()
    if open_rows is not None:
        have = open_rows.filter(F.col(key).isNotNull()).select(key, F.col(UPDATED_AT).alias("__u"), F.lit(True).alias("__has"))
        dated = (dated.join(have, key, "left").filter(F.col("__has").isNull() | (F.col(updated_at) > F.col("__u")))
                 .drop("__u", "__has"))
    # lead() needs one row ahead only: a key with very many versions is sorted
    # with spill, not held in memory.
    ahead = F.lead(F.struct(F.col(updated_at).alias("t"))).over(Window.partitionBy(key).orderBy(updated_at))
    new = dated.withColumn("__next", ahead)
    null_keyed = changes.filter(F.col(key).isNull()).withColumn("__next", F.lit(None).cast(new.schema["__next"].dataType))
    rows = new.unionByName(null_keyed)
    versions = rows.select(
        *changes.columns, scd_id(key, updated_at).alias(SCD_ID), F.col(updated_at).alias(UPDATED_AT),
        at(F.col(updated_at)).alias(VALID_FROM),
        F.when(F.col("__next").isNotNull(), at(F.col("__next.t"))).cast(ts_type).alias(VALID_TO))
    if open_rows is None:
        return versions
    first = dated.groupBy(key).agg(F.min(updated_at).alias("__first"), F.lit(True).alias("__newer"))
    kept = (open_rows.join(first, key, "left")
            .withColumn(VALID_TO, F.when(F.col("__newer"), at(F.col("__first"))).otherwise(F.col(VALID_TO)))
            .select(*open_rows.columns))
    return _union(kept, versions)


def _union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name, case-insensitive; columns missing on one side are
    NULL there (a source that gains a column adds it to history)."""
    have = {c.lower() for c in a.columns}
    extra = [c for c in b.columns if c.lower() not in have]
    order = _data_columns(a) + [c for c in extra if c.lower() not in {s.lower() for s in SCD_COLUMNS}]
    scd = [c for c in a.columns if c.lower() in {s.lower() for s in SCD_COLUMNS}]
    u = a.unionByName(b, allowMissingColumns=True)
    return u.select(*order, *scd)


def cycle(snap: DataFrame, source: DataFrame, key: str, updated_at: str, run_ts,
          hard_deletes: bool = False, ts_type: str = "timestamp") -> DataFrame:
    """The whole snapshot after one run (closed history passes through)."""
    history = snap.filter(F.col(VALID_TO).isNotNull())
    open_after = cycle_open(current_rows(snap), source, key, updated_at, run_ts,
                            hard_deletes, ts_type)
    return _union(history, open_after)


def invalidate(snap: DataFrame, source: DataFrame, key: str, updated_at: str, run_ts,
               ts_type: str = "timestamp") -> DataFrame:
    """N2 alone: close open versions with a newer source row."""
    run = _run(run_ts, ts_type)
    per_key, _, _ = _source_facts(source, key, updated_at)
    j = snap.filter(F.col(key).isNotNull()).join(per_key, key, "left")
    close = F.col(VALID_TO).isNull() & F.coalesce(F.col("__src_max") > F.col(UPDATED_AT),
                                                  F.lit(False))
    closed = j.withColumn(VALID_TO, F.when(close, run).otherwise(F.col(VALID_TO))).select(*snap.columns)
    return closed.unionByName(snap.filter(F.col(key).isNull()))


def insert_versions(snap: DataFrame, source: DataFrame, key: str, updated_at: str, run_ts,
                    ts_type: str = "timestamp") -> DataFrame:
    """N3 alone: the versions the insert step adds to ``snap``."""
    new = changed_or_new(source, current_rows(snap), key, updated_at)
    return _versions(new, key, updated_at, _run(run_ts, ts_type), ts_type)


def hard_delete(snap: DataFrame, source: DataFrame, key: str, run_ts,
                ts_type: str = "timestamp") -> DataFrame:
    """N4 alone: close open versions whose key is NOT IN the source."""
    run = _run(run_ts, ts_type)
    per_key = source.filter(F.col(key).isNotNull()).select(key).distinct() \
        .withColumn("__in_src", F.lit(True))
    n_src, n_null = _list_facts(source, key)
    j = snap.filter(F.col(key).isNotNull()).join(per_key, key, "left")
    gone = (n_src == 0) | (F.col("__in_src").isNull() & (n_null == 0))
    close = F.col(VALID_TO).isNull() & gone
    keyed = j.withColumn(VALID_TO, F.when(close, run).otherwise(F.col(VALID_TO))).select(*snap.columns)
    nulls = snap.filter(F.col(key).isNull())
    nulls = nulls.withColumn(VALID_TO, F.when(F.col(VALID_TO).isNull() & (n_src == 0), run)
                             .otherwise(F.col(VALID_TO))).select(*snap.columns)
    return keyed.unionByName(nulls)
