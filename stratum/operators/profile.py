"""Mergeable column statistics: rows, and per column nulls, logical bytes, least and greatest value.

They are plain aggregates, so that ``observe`` can take them while the rows are
written, and they merge: those of a table are the sum, minimum and maximum of
those of its folders.  Least and greatest values travel as text that keeps the
value exactly; times as microseconds, dates as days, so that no time zone plays
a part.  Texts longer than LONGEST have no bounds, nor have nested and binary
values; a column without bounds that is not all NULL is *unknown*, and whoever
asks must read it.
"""

from __future__ import annotations

import datetime as _dt
import json
import math
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.operators.stats import logical_bytes

#: Characters of the longest text that is kept as a bound.
LONGEST = 256
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def bounded(dt: T.DataType) -> bool:
    return isinstance(dt, (T.NumericType, T.BooleanType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))


def encoded(value: Column, dt: T.DataType) -> Column:
    """A bound as text."""
    if isinstance(dt, T.DateType):
        return F.unix_date(value).cast("string")
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(value).cast("string")
    if isinstance(dt, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), value).cast("string")
    if isinstance(dt, T.StringType):
        return F.when(F.char_length(value) <= LONGEST, value)
    return value.cast("string")


def decoded(text: str | None, dt: T.DataType) -> Column:
    """The bound as a literal of its type."""
    if text is None:
        return F.lit(None).cast(dt)
    if isinstance(dt, T.DateType):
        return F.date_from_unix_date(F.lit(int(text)))
    if isinstance(dt, T.TimestampType):
        return F.timestamp_micros(F.lit(int(text)).cast("long"))
    if isinstance(dt, T.TimestampNTZType):
        return F.timestamp_add("MICROSECOND", F.lit(int(text)).cast("long"), F.expr(EPOCH))
    return F.lit(text).cast(dt)


def text_of(value, dt: T.DataType) -> str | None:
    """A Python value (as the driver gets one of type ``dt``) as a bound's text; None if it has no such form."""
    if isinstance(dt, T.DateType) and type(value) is _dt.date:
        return str((value - _dt.date(1970, 1, 1)).days)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)) and isinstance(value, _dt.datetime):
        if isinstance(dt, T.TimestampType) != (value.tzinfo is not None):
            return None
        return str((value - _dt.datetime(1970, 1, 1, tzinfo=value.tzinfo and _dt.timezone.utc)) // _dt.timedelta(microseconds=1))
    if isinstance(dt, T.BooleanType) and isinstance(value, bool):
        return str(value).lower()
    if isinstance(dt, T.StringType) and isinstance(value, str):
        return value
    if isinstance(dt, T.NumericType) and isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
        return str(value)
    return None


def may_hold(p: "Profile", column: str, dt: T.DataType, low, high, null: bool = False) -> bool:
    """Whether rows of a profile can have a value from ``low`` to ``high`` (None: open), or NULL."""
    c = p.columns.get(column)
    if c is None or not p.rows:
        return bool(p.rows) or c is None
    if null:
        return c.nulls > 0
    if c.nulls == p.rows:
        return False
    if c.low is None or c.high is None:
        return True
    low, high = (None if x is None else text_of(x, dt) for x in (low, high))
    at = lambda t: _order(t, dt)
    return not ((low is not None and at(c.high) < at(low)) or (high is not None and at(high) < at(c.low)))


def ends(p: "Profile", column: str, dt: T.DataType) -> tuple:
    """What the known bounds of a column are ordered by."""
    c = p.columns[column]
    return _order(c.low, dt), _order(c.high, dt)


def _order(text: str, dt: T.DataType):
    """What bounds of one type are compared by, as Spark orders their values."""
    if isinstance(dt, T.StringType):
        return text.encode("utf-8", "surrogatepass")
    if isinstance(dt, T.BooleanType):
        return text == "true"
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        x = float(text)
        return (1, 0.0) if math.isnan(x) else (0, x)  # NaN is the greatest
    return Decimal(text)


@dataclass
class ColumnProfile:
    nulls: int = 0
    bytes: int = 0
    low: str | None = None
    high: str | None = None


@dataclass
class Profile:
    rows: int = 0
    columns: dict[str, ColumnProfile] = field(default_factory=dict)

    def known(self, column: str) -> bool:
        """Whether the bounds of ``column`` are known, be it that it has no value."""
        c = self.columns.get(column)
        return c is not None and (c.low is not None or c.nulls == self.rows)

    def json(self) -> str:
        return json.dumps([self.rows, {n: [c.nulls, c.bytes, c.low, c.high] for n, c in self.columns.items()}])

    @staticmethod
    def of(text: str) -> "Profile":
        rows, columns = json.loads(text)
        return Profile(rows, {n: ColumnProfile(*c) for n, c in columns.items()})


def merged(profiles: list[Profile], schema: T.StructType) -> Profile:
    """The profile of all rows together, of the columns of ``schema``; one that is unknown anywhere has no bounds."""
    out = Profile(sum(p.rows for p in profiles))
    for f in schema:
        parts = [(p, p.columns.get(f.name)) for p in profiles if p.rows]
        if any(c is None for _, c in parts):
            continue
        total = ColumnProfile(sum(c.nulls for _, c in parts), sum(c.bytes for _, c in parts))
        with_values = [c for p, c in parts if c.nulls < p.rows]
        if with_values and all(c.low is not None for c in with_values):
            total.low = min((c.low for c in with_values), key=lambda t: _order(t, f.dataType))  # noqa: B023
            total.high = max((c.high for c in with_values), key=lambda t: _order(t, f.dataType))  # noqa: B023
        out.columns[f.name] = total
    return out


def aggregates(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """The aggregates of a profile, for ``agg`` or ``observe``; ``from_row`` reads them."""
    out = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(_fields(df.schema, columns)):
        c = df[f"`{f.name}`"]
        out += [F.count_if(c.isNull()).alias(f"n{i}"), F.coalesce(F.sum(logical_bytes(c, f.dataType)), F.lit(0).cast("long")).alias(f"b{i}")]
        if bounded(f.dataType):
            out += [encoded(F.min(c), f.dataType).alias(f"l{i}"), encoded(F.max(c), f.dataType).alias(f"h{i}")]
    return out


def _fields(schema: T.StructType, columns: list[str] | None) -> list[T.StructField]:
    wanted = None if columns is None else set(columns)
    return [f for f in schema if wanted is None or f.name in wanted]


def from_row(schema: T.StructType, row: Row | dict, columns: list[str] | None = None) -> Profile:
    """The profile in a row (or observed values) of ``aggregates``; no values means no rows."""
    got = row.asDict() if isinstance(row, Row) else dict(row)
    out = Profile(got.get("rows") or 0)
    for i, f in enumerate(_fields(schema, columns)):
        low, high = got.get(f"l{i}"), got.get(f"h{i}")
        both = low is not None and high is not None
        out.columns[f.name] = ColumnProfile(got.get(f"n{i}") or 0, got.get(f"b{i}") or 0, low if both else None, high if both else None)
    return out
