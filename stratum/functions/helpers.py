"""Helper column functions (F1-F9) and the grouped string concatenation.

All of them return built-in Spark expressions, so they stay inside whole-stage
codegen and are pushed through Catalyst like any other column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratum.functions.util import as_col, ts_literal

# Fixed values that must equal the reference's output.
# NULL stand-in used by the surrogate key before hashing:
SURROGATE_NULL = "_dbt_utils_surrogate_key_null_"
# Separator between key and version time inside the snapshot row id:
SCD_ID_SEPARATOR = "|"


def surrogate_key(*cols, sep: str | None = None) -> Column:
    """hex md5 of the columns cast to string, NULL replaced by a token.

    No separator by default, so ('a', 'bc') and ('ab', 'c') collide; pass
    ``sep`` to join parts with a separator instead.
    """
    if len(cols) == 1 and isinstance(cols[0], (list, tuple)):
        cols = tuple(cols[0])
    if not cols:
        raise ValueError("surrogate_key needs at least one column")
    parts = [F.coalesce(as_col(c).cast("string"), F.lit(SURROGATE_NULL)) for c in cols]
    if sep is not None:
        return F.md5(F.concat_ws(sep, *parts))
    return F.md5(parts[0] if len(parts) == 1 else F.concat(*parts))


_UNITS = {
    "microsecond": "MICROSECOND", "millisecond": "MILLISECOND", "second": "SECOND",
    "minute": "MINUTE", "hour": "HOUR", "day": "DAY", "week": "WEEK",
    "month": "MONTH", "quarter": "QUARTER", "year": "YEAR",
}


def _unit(part: str) -> str:
    p = part.strip().strip("'\"").lower()
    if p.endswith("s") and p[:-1] in _UNITS:
        p = p[:-1]
    if p not in _UNITS:
        raise ValueError(f"unknown date part {part!r}; known: {sorted(_UNITS)}")
    return _UNITS[p]


def datediff(start, end, part: str) -> Column:
    """whole ``part`` units elapsed from ``start`` to ``end`` (end - start)."""
    return F.timestamp_diff(_unit(part), as_col(start), as_col(end))


def dateadd(part: str, amount, expr) -> Column:
    """``expr`` shifted by ``amount`` units of ``part``."""
    amt = F.lit(amount) if isinstance(amount, int) else as_col(amount)
    return F.timestamp_add(_unit(part), amt, as_col(expr))


def run_timestamp(run_ts=None) -> Column:
    """the run's timestamp; a fixed value when given, else now()."""
    if run_ts is None:
        return F.current_timestamp()
    if isinstance(run_ts, Column):
        return run_ts
    return ts_literal(run_ts, "timestamp")


def month_start(expr, granularity: str = "month", ts_type: str = "timestamp_ntz") -> Column:
    """truncate to the granularity.

    ``date_trunc`` returns TIMESTAMP (with zone) for any input; the result is
    cast to ``ts_type``, so pass "timestamp" for a column with zone.
    """
    return F.date_trunc(granularity, as_col(expr)).cast(ts_type)


def safe_divide(num, den) -> Column:
    """NULL when the denominator is zero or NULL."""
    return F.try_divide(as_col(num), as_col(den))


def cents_to_dollars(expr, rounded: bool = False) -> Column:
    """the two shipped forms: ``CAST(x AS FLOAT64)/100.0`` or ``ROUND(x/100, 2)``."""
    c = as_col(expr)
    if rounded:
        return F.round(c / F.lit(100), 2)
    return c.cast("double") / F.lit(100.0)


def listagg(measure, delimiter: str = ",", order_by=None) -> Column:
    """Concatenate group values with a delimiter, optionally ordered.

    Maps to Spark's ``listagg(x, d) WITHIN GROUP (ORDER BY y)``; the ordering
    should be unique inside a group to make the result deterministic.  With
    column names (or SQL expressions) the native ordered aggregate is used;
    Column objects fall back to sorting (order, value) pairs.
    """
    if order_by is None:
        return F.listagg(as_col(measure), F.lit(delimiter))
    if isinstance(measure, str) and isinstance(order_by, str):
        d = delimiter.replace("\\", "\\\\").replace("'", "\\'")
        return F.expr(f"listagg({measure}, '{d}') WITHIN GROUP (ORDER BY {order_by})")
    pairs = F.array_sort(F.collect_list(F.struct(as_col(order_by).alias("o"),
                                                 as_col(measure).alias("m"))))
    # NULL for a group without values, as the native aggregate gives.
    return F.when(F.count(as_col(measure)) > 0, F.array_join(F.transform(pairs, lambda p: p["m"]), delimiter))
