"""Incremental load strategies (I1-I7) as pure DataFrame -> DataFrame functions.

``target`` (T) is the stored table, ``source`` (S) the model result for this
run.  Each function returns the *whole* new content of T; the store writes it
as the next version (or, for partitioned tables, only the touched partitions,
see ``stratum.plans.project``).

Plan shape.  T is the big side.  Every join below keeps T on the streamed
(left) side and only a key projection of S on the build side, so when the
increment is small AQE turns the join into a broadcast hash join from the
*measured* size of S's shuffle output (that measurement is the size check;
above ``spark.sql.adaptive.autoBroadcastJoinThreshold`` it stays a sort-merge
join and AQE's skew handling splits hot keys of T).  Nothing here forces a
broadcast of data whose size is not known.

Key semantics follow SQL ``=``: a NULL key never matches, so NULL-key rows of
T are kept and NULL-key rows of S are inserted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions.util import key_list


#: Rows that ``by_key`` gives one task, about.
ROWS_PER_TASK = 1 << 19


class DuplicateKeyError(ValueError):
    pass


class NewColumnsError(ValueError):
    """The source has columns that the target lacks."""


def extra_columns(source: DataFrame, target: DataFrame) -> list[str]:
    """Columns of ``source`` that ``target`` lacks, by case-insensitive name."""
    have = {c.lower() for c in target.columns}
    return [c for c in source.columns if c.lower() not in have]


def by_key(rows: DataFrame, key) -> DataFrame:
    """``rows`` dealt by their keys to as many tasks as their number asks for.

    Grouping by the key and merges on it then need no other shuffle, and what a
    task's hash tables and sorts hold does not grow with the table, whatever
    number of shuffle partitions the session has.  For keys that few rows share:
    rows are not reduced before they move."""
    keys = _resolve_keys(rows, key_list(key))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_TASK))
    return rows.repartition(tasks, *keys)


def align_to(df: DataFrame, like: DataFrame | list[str]) -> DataFrame:
    """Project ``df`` onto the columns of ``like`` by case-insensitive name,
    in ``like``'s order (INSERT ROW follows the target's columns).  A column
    that a target DataFrame lacks raises: it is never left out silently."""
    names = like if isinstance(like, list) else like.columns
    have = {c.lower(): c for c in df.columns}
    missing = [n for n in names if n.lower() not in have]
    if missing:
        raise ValueError(f"source lacks target columns {missing}; source has {df.columns}")
    if not isinstance(like, list) and (new := extra_columns(df, like)):
        raise NewColumnsError(f"the target lacks the source's columns {new}; add them to it "
                              "(on_schema_change='append' on a model) or leave them out")
    types = None if isinstance(like, list) else {f.name: f.dataType for f in like.schema}
    cols = []
    for n in names:
        c = F.col(have[n.lower()])
        if types is not None:
            c = c.cast(types[n])
        cols.append(c.alias(n))
    return df.select(*cols)


def _resolve_keys(df: DataFrame, keys: list[str]) -> list[str]:
    have = {c.lower(): c for c in df.columns}
    out = []
    for k in keys:
        if k.lower() not in have:
            raise ValueError(f"unique key {k!r} not in columns {df.columns}")
        out.append(have[k.lower()])
    return out


def duplicate_source_keys(target: DataFrame, source: DataFrame, key) -> DataFrame:
    """Keys that appear more than once in S *and* match a row of T.

    Those make a MERGE ambiguous.  The grouping is partially aggregated on the
    map side, so a hot key collapses to one row per task before the shuffle.
    """
    keys = _resolve_keys(source, key_list(key))
    dup = (source.groupBy(*keys).count().filter(F.col("count") > 1)
           .drop("count").dropna(subset=keys))
    tkeys = _resolve_keys(target, keys)
    t = target.select(*[F.col(a).alias(b) for a, b in zip(tkeys, keys)])
    # The target streams; the (small) set of repeated increment keys is the
    # build side.
    return t.join(dup, keys, "left_semi").distinct()


DUPLICATE_MESSAGE = ("MERGE would match one target row with several source rows; "
                     "pass on_duplicate='last' with order_by, or 'keep'")


def _dedupe(source: DataFrame, keys: list[str], on_duplicate: str, order_by, target: DataFrame):
    if on_duplicate in ("keep", "error"):
        # 'error' is checked inside the merge plan itself (see merge_upsert).
        return source
    if on_duplicate == "check":
        if duplicate_source_keys(target, source, keys).limit(1).count() > 0:
            raise DuplicateKeyError(DUPLICATE_MESSAGE + f" (keys {keys})")
        return source
    if on_duplicate == "last":
        if order_by is None:
            raise ValueError("on_duplicate='last' needs order_by")
        # max_by over a struct is a partial aggregate: a hot key is reduced on
        # the map side, never collected whole into one task.
        others = [c for c in source.columns if c not in keys]
        o = F.col(order_by) if isinstance(order_by, str) else order_by
        latest = source.groupBy(*keys).agg(
            F.max_by(F.struct(*[F.col(c) for c in others]), o).alias("__row"))
        nulls = source.filter(" OR ".join(f"`{k}` IS NULL" for k in keys))
        kept = latest.dropna(subset=keys).select(*keys, "__row.*").select(*source.columns)
        return kept.unionByName(nulls)
    raise ValueError("on_duplicate must be 'error', 'check', 'last', 'newest' or 'keep', "
                     f"got {on_duplicate!r}")


def merge_upsert(target: DataFrame, source: DataFrame, key, on_duplicate: str = "error",
                 order_by=None) -> DataFrame:
    """Matched rows take every non-key column from S, unmatched S
    rows are inserted, the rest of T is kept.

    If every target column is a key there is nothing to update and this is
    ``merge_keys_only`` (I2).

    Several S rows matching one T row make a MERGE ambiguous.  With
    ``on_duplicate='error'`` (default) that is detected inside the same
    join that drops the replaced T rows: T is left-joined to S's per-key row
    counts, rows without a count are kept, and a count above one raises when
    the result is computed -- no extra job and no second scan of T.
    ``'check'`` raises eagerly (one extra job), ``'last'`` keeps the latest
    S row per key, ``'keep'`` inserts them all.  ``'newest'`` keeps the row of T and S
    with the greatest ``order_by`` (see ``merge_newest``).
    """
    keys = _resolve_keys(target, key_list(key))
    if {c.lower() for c in target.columns} <= {k.lower() for k in keys}:
        return merge_insert_only(target, source, keys)
    if on_duplicate == "newest":
        return merge_newest(target, source, keys, order_by)
    s = align_to(source, target)
    s = _dedupe(s, keys, on_duplicate, order_by, target)
    if on_duplicate != "error":
        kept = target.join(_key_set(s, keys), keys, "left_anti")
        return kept.unionByName(s)
    # Per-key counts: a partial aggregate, unique per key (a hot key is one
    # row), so it is a safe build side.
    counts = s.select(*keys).dropna().groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    j = target.join(counts, keys, "left")
    guard = F.when(F.col("__n") > 1, F.raise_error(F.lit(DUPLICATE_MESSAGE)))
    kept = j.filter(guard.isNull() & F.col("__n").isNull()).select(*target.columns)
    return kept.unionByName(s)


def require_unique(rows: DataFrame, key) -> None:
    """Raise if a non-NULL key repeats, matched or not (one partial aggregate)."""
    keys = _resolve_keys(rows, key_list(key))
    if not rows.dropna(subset=keys).groupBy(*keys).count().filter(F.col("count") > 1).isEmpty():
        raise DuplicateKeyError(f"the increment repeats keys {keys}; give an order_by column")


def newest(rows: DataFrame, key, order_by: str) -> DataFrame:
    """One row per key: the greatest by ``order_by`` (NULL first), ties by the
    other columns in order; rows with a NULL key all stay.  The maximum of a
    struct is a partial aggregate, so a hot key is reduced on the map side."""
    keys = _resolve_keys(rows, key_list(key))
    by = _resolve_keys(rows, [order_by])[0]
    others = [by] + [c for c in rows.columns if c not in keys and c != by]
    best = rows.dropna(subset=keys).groupBy(*keys).agg(F.max(F.struct(*others)).alias("__row"))
    nulls = rows.filter(" OR ".join(f"`{k}` IS NULL" for k in keys))
    return best.select(*keys, "__row.*").select(*rows.columns).unionByName(nulls)


def merge_newest(target: DataFrame, source: DataFrame, key, order_by: str) -> DataFrame:
    """Upsert that keeps, per key, the row of T or S with the greatest
    ``order_by``.  However S is cut into increments, and in whatever order they
    come, the result is the same."""
    if order_by is None:
        raise ValueError("on_duplicate='newest' needs order_by")
    keys = _resolve_keys(target, key_list(key))
    s = align_to(source, target)
    touched = _key_set(s, keys)
    rest = target.join(touched, keys, "left_anti")
    both = target.join(touched, keys, "left_semi").unionByName(s)
    return rest.unionByName(newest(both, keys, order_by))


def _key_set(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct non-NULL keys: the build side of a semi / anti join.  The
    DISTINCT is a partial aggregate, so a key repeated in a third of the
    rows collapses on the map side instead of landing in one build task;
    NULL keys never match, so they are dropped up front."""
    return df.select(*keys).dropna().distinct()


def merge_insert_only(target: DataFrame, source: DataFrame, key) -> DataFrame:
    """Insert S rows whose key has no match in T; never update.

    Written as "T keys that S touches" (T streamed, S keys on the build side)
    followed by an anti join of S against that small key set, so T is never
    the build side of a join.
    """
    return target.unionByName(new_rows(target, source, key))


def new_rows(target: DataFrame, source: DataFrame, key) -> DataFrame:
    """The rows of S whose key has no match in T: what insert-only adds."""
    keys = _resolve_keys(target, key_list(key))
    s = align_to(source, target)
    matched = target.select(*keys).join(_key_set(s, keys), keys, "left_semi").distinct()
    return s.join(matched, keys, "left_anti")


merge_keys_only = merge_insert_only


def delete_insert(target: DataFrame, source: DataFrame, key) -> DataFrame:
    """Delete T rows whose key is in S, then insert all S rows.

    Duplicates in S are kept; a row of T with a NULL key part is never deleted
    (tuple IN with a NULL is not true).
    """
    keys = _resolve_keys(target, key_list(key))
    s = align_to(source, target)
    kept = target.join(_key_set(s, keys), keys, "left_anti")
    return kept.unionByName(s)


def append(target: DataFrame, source: DataFrame) -> DataFrame:
    """Insert all S rows, no dedup."""
    return target.unionByName(align_to(source, target))


def full_replace(target: DataFrame, source: DataFrame) -> DataFrame:
    """Replace all rows, keep T's schema (types and column metadata)."""
    return align_to(source, target).to(target.schema)


STRATEGIES = {
    "merge": merge_upsert,
    "insert_only": merge_insert_only,
    "delete+insert": delete_insert,
    "append": append,
    "replace": full_replace,
}


def apply_strategy(strategy: str, target: DataFrame, source: DataFrame, key=None,
                   **kw) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown incremental strategy {strategy!r}; known: {sorted(STRATEGIES)}")
    fn = STRATEGIES[strategy]
    if strategy in ("append", "replace"):
        return fn(target, source)
    if key is None:
        raise ValueError(f"strategy {strategy!r} needs unique_key")
    if strategy == "merge":
        return fn(target, source, key, **kw)
    return fn(target, source, key)
