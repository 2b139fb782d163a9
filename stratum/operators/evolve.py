"""Schema evolution (E1-E6, E11) as one projection.

The declared fields carry ``alter`` annotations (insert / rename / delete);
unannotated fields may only change their description.  Every step is
idempotent: a drop of a missing column, a rename whose source is gone and
an insert of an existing column are skipped, so re-running an evolution is
a no-op.

All operations are applied *simultaneously* in one ``select`` over the old
columns: renames read the old names, so swaps (a<->b), cycles and chains
(a->b, b->c) need no temporary names and no ordering, and Catalyst collapses
the projection into the scan -- no data is rewritten column by column.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.types import Field, SchemaError, metadata, spark_type


@dataclass
class EvolutionPlan:
    drops: list[str] = field(default_factory=list)
    renames: dict[str, str] = field(default_factory=dict)    # old -> new
    adds: list[Field] = field(default_factory=list)
    describes: dict[str, str | None] = field(default_factory=dict)

    @property
    def empty(self) -> bool:
        return not (self.drops or self.renames or self.adds or self.describes)


def _comment(df: DataFrame, name: str):
    return next((f.metadata.get("comment") for f in df.schema if f.name == name), None)


def plan(df: DataFrame, fields: list[Field]) -> EvolutionPlan:
    """Diff the frame's columns against the annotated declaration."""
    have = {c.lower(): c for c in df.columns}
    p = EvolutionPlan()
    for f in fields:
        if f.alter == "delete":
            if f.name.lower() in have:
                p.drops.append(have[f.name.lower()])
        elif f.alter == "rename":
            if f.alter_from and f.alter_from.lower() in have:
                p.renames[have[f.alter_from.lower()]] = f.name
        elif f.alter == "insert":
            if f.name.lower() not in have:
                p.adds.append(f)
        elif f.name.lower() in have:
            cur = have[f.name.lower()]
            if _comment(df, cur) != f.description:
                p.describes[cur] = f.description
    dropped = {d.lower() for d in p.drops}
    for old in p.renames:
        if old.lower() in dropped:
            raise SchemaError(f"column {old!r} is both dropped and renamed")
    final = [p.renames.get(c, c).lower() for c in df.columns if c.lower() not in dropped]
    final += [a.name.lower() for a in p.adds]
    dup = {c for c in final if final.count(c) > 1}
    if dup:
        raise SchemaError(f"evolution would produce duplicate columns {sorted(dup)}")
    return p


def _with_comment(c: Column, name: str, base: dict, comment) -> Column:
    md = dict(base)
    if comment is None:
        md.pop("comment", None)
    else:
        md["comment"] = comment
    return c.alias(name, metadata=md)


def apply(df: DataFrame, p: EvolutionPlan, backfill: bool = False) -> DataFrame:
    """E5: drop -> rename -> add -> describe, as one projection.

    Added columns are NULL in existing rows unless ``backfill`` is set, in
    which case a declared default expression fills them.  A REPEATED column
    is added as an array.
    """
    dropped = {d.lower() for d in p.drops}
    cols = []
    for f in df.schema:
        if f.name.lower() in dropped:
            continue
        new = p.renames.get(f.name, f.name)
        comment = p.describes.get(f.name, f.metadata.get("comment"))
        cols.append(_with_comment(F.col(f"`{f.name}`"), new, f.metadata, comment))
    for a in p.adds:
        dt = spark_type(a)
        if backfill and a.default_value_expression is not None:
            c = F.expr(a.default_value_expression).cast(dt)
        else:
            c = F.lit(None).cast(dt)
        cols.append(c.alias(a.name, metadata=metadata(a)))
    return df.select(*cols)


def evolve(df: DataFrame, fields: list[Field], backfill: bool = False) -> DataFrame:
    return apply(df, plan(df, fields), backfill)


def add_columns(df: DataFrame, fields: list[Field], backfill: bool = False) -> DataFrame:
    """E1."""
    return evolve(df, [Field(f.name, f.type, f.mode, f.description, f.default_value_expression,
                             f.rounding_mode, f.fields, "insert") for f in fields], backfill)


def drop_columns(df: DataFrame, names: list[str], consumers: list[dict] | None = None) -> DataFrame:
    """E2 with the drop-safety guard."""
    check_drop_safety(names, consumers or [])
    return evolve(df, [Field(n, alter="delete") for n in names])


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Simultaneous renames (swaps and chains allowed)."""
    return evolve(df, [Field(new, alter="rename", alter_from=old) for old, new in mapping.items()])


def check_drop_safety(drops: list[str], consumers: list[dict]) -> None:
    """Refuse to drop a column a consumer uses as unique key, partition
    or cluster column, or as a snapshot's version column.  ``consumers`` are
    dicts with ``name`` and optional ``unique_key`` / ``partition_by`` /
    ``cluster_by`` / ``version_column`` lists."""
    d = {x.lower() for x in drops}
    for c in consumers:
        for role in ("unique_key", "partition_by", "cluster_by", "version_column"):
            used = c.get(role) or []
            used = [used] if isinstance(used, str) else used
            for col in used:
                if col.lower() in d:
                    raise SchemaError(f"cannot drop {col!r}: {c.get('name')!r} uses it "
                                      f"as {role.replace('_', ' ')}")


def round_column(c: Column, mode: str, scale: int) -> Column:
    """Half away from zero (``round``) or half to even (``bround``)."""
    if mode == "ROUND_HALF_AWAY_FROM_ZERO":
        return F.round(c, scale)
    if mode == "ROUND_HALF_EVEN":
        return F.bround(c, scale)
    raise SchemaError(f"unknown rounding mode {mode!r}")


def apply_rounding(df: DataFrame, fields: list[Field]) -> DataFrame:
    """Round NUMERIC (scale 9) / BIGNUMERIC (scale 18) columns by their
    declared rounding mode, then cast to the declared decimal type."""
    modes = {f.name.lower(): f for f in fields if f.rounding_mode}
    out = []
    for c in df.columns:
        f = modes.get(c.lower())
        if f is None:
            out.append(F.col(c))
            continue
        scale = 18 if f.canonical == "BIGNUMERIC" else 9
        out.append(round_column(F.col(c), f.rounding_mode, scale).cast(spark_type(f)).alias(c))
    return df.select(*out)
