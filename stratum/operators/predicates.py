"""Subquery predicates and one-row attachment.

The subquery side of every semi / anti join is reduced to its distinct
non-NULL keys first (a partial aggregate): duplicates never change a semi or
anti join's result, and a key repeated in a third of the rows would
otherwise land in one build task.

``NOT IN (subquery)`` has three-valued semantics: one NULL in the list makes
the predicate NULL for every row, and a NULL probe value matches nothing
unless the list is empty.  Spark plans ``NOT IN`` as a null-aware anti join,
which is a hash join only when the subquery side is broadcast; otherwise it
falls back to a nested-loop join, quadratic at scale.  ``not_in`` below
splits the semantics into an ordinary (shuffle or broadcast) anti join plus
two scalar facts about the list, so it scales like any equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions.util import key_list


def _rename(df: DataFrame, src: list[str], dst: list[str]) -> DataFrame:
    return df.select(*[F.col(a).alias(b) for a, b in zip(src, dst)])


def is_in(left: DataFrame, right: DataFrame, left_key, right_key=None) -> DataFrame:
    """Rows of ``left`` whose key (single or tuple) is IN the subquery.

    A semi join: NULL never matches, which is exactly where IN is not true.
    """
    lk = key_list(left_key)
    rk = key_list(right_key or left_key)
    return left.join(_rename(right, rk, lk).dropna().distinct(), lk, "left_semi")


def not_in(left: DataFrame, right: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    """Rows of ``left`` for which ``left_key NOT IN (SELECT right_key ...)`` is true."""
    rk = right_key or left_key
    r = right.select(F.col(rk).alias(left_key))
    # One scalar subquery (a one-row global aggregate) for both facts.
    facts = r.agg(F.struct(F.count(F.lit(1)).alias("n"),
                           F.count_if(F.col(left_key).isNull()).alias("nulls"))).scalar()
    n, nulls = facts.getField("n"), facts.getField("nulls")
    survivors = left.join(r.dropna().distinct(), left_key, "left_anti")
    return survivors.filter((nulls == 0) & (F.col(left_key).isNotNull() | (n == 0)))


def anti(left: DataFrame, right: DataFrame, left_key, right_key=None) -> DataFrame:
    """NOT EXISTS -- rows of ``left`` with no equal key in ``right``
    (NULL keys are kept: they match nothing)."""
    lk = key_list(left_key)
    rk = key_list(right_key or left_key)
    return left.join(_rename(right, rk, lk).dropna().distinct(), lk, "left_anti")


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """The cross join of a table with a one-row model.

    The row becomes one scalar subquery (a struct), evaluated once and shipped
    to every task as a literal -- no pair enumeration, no shuffle.  A global
    aggregate has one row by construction; a model that turns out empty gives
    no rows, as a cross join does, and one with several rows raises.
    """
    row = one_row.select(F.struct(*[F.col(f"`{c}`") for c in one_row.columns])).scalar()
    return df.filter(row.isNotNull()).select("*", *[row.getField(c).alias(c) for c in one_row.columns])
