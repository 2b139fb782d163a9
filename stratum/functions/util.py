from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    """Accept a Column or a column name."""
    return c if isinstance(c, Column) else F.col(c)


def key_list(key) -> list[str]:
    """A unique key given as one name or a list of names."""
    if isinstance(key, str):
        return [key]
    keys = list(key)
    if not keys:
        raise ValueError("unique key must name at least one column")
    return keys


def ts_literal(value, ts_type: str = "timestamp_ntz") -> Column:
    """A timestamp literal from a string or a naive ``datetime``, built from
    its ISO text so the value does not depend on the Python process's time
    zone (a ``datetime`` handed to ``F.lit`` is converted through it)."""
    import datetime as _dt
    if isinstance(value, Column):
        return value.cast(ts_type)
    if isinstance(value, _dt.datetime):
        value = value.replace(tzinfo=None).isoformat(sep=" ")
    elif isinstance(value, _dt.date):
        value = value.isoformat()
    return F.lit(value).cast(ts_type)
