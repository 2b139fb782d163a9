"""Bounds of columns that a predicate implies.

Spark's optimizer already knows which simple comparisons hold for every row that
a predicate lets through: those it would push down to a data source, with
literals folded, casts moved to the literal and ``NOT`` resolved.  ``bounds``
asks for them through the public Python data source interface: it plans (and
never runs) the predicate over a source that notes what is pushed down.  What is
not a plain comparison, such as an OR of columns, implies nothing here.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

SOURCE = "stratum_implied"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Bounds:
    """Least and greatest value that a column can have (both included, None: open), or that it is NULL."""

    low: object = None
    high: object = None
    null: bool = False

    def at_least(self, value) -> None:
        self.low = value if self.low is None else max(self.low, value)

    def at_most(self, value) -> None:
        self.high = value if self.high is None else min(self.high, value)

    @property
    def any(self) -> bool:
        return self.null or self.low is not None or self.high is not None


class _Reader(ds.DataSourceReader):
    def __init__(self, note: str):
        self.note = note

    def pushFilters(self, filters):  # noqa: N802 - the interface's name
        with open(self.note, "wb") as f:
            pickle.dump([(type(x).__name__, x.attribute, getattr(x, "value", None)) for x in filters if hasattr(x, "attribute")], f)
        return filters

    def read(self, partition):
        yield from ()


class _Source(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return SOURCE

    def reader(self, schema: T.StructType) -> ds.DataSourceReader:
        return _Reader(self.options["note"])


_REGISTERED: set[int] = set()


def pushed(spark: SparkSession, schema: T.StructType, predicate: Column | str) -> list[tuple[str, tuple[str, ...], object]]:
    """The comparisons that every row of the predicate meets: (kind, column, value)."""
    if id(spark) not in _REGISTERED:
        spark.dataSource.register(_Source)
        _REGISTERED.add(id(spark))
    # Planning runs on the driver's machine, so the note is a file of its own there.
    handle, note = tempfile.mkstemp(prefix="stratum-implied-")
    os.close(handle)
    before = spark.conf.get(PUSHDOWN, None)
    spark.conf.set(PUSHDOWN, "true")
    try:
        spark.read.format(SOURCE).schema(schema).option("note", note).load().filter(predicate).inputFiles()   # plans only
        with open(note, "rb") as f:
            noted = f.read()
    finally:
        spark.conf.unset(PUSHDOWN) if before is None else spark.conf.set(PUSHDOWN, before)
        os.unlink(note)
    return pickle.loads(noted) if noted else []


def bounds(spark: SparkSession, schema: T.StructType, predicate: Column | str) -> dict[str, Bounds]:
    """What the predicate implies for top-level columns; a column without an entry can have any value."""
    found: dict[str, Bounds] = {}
    for kind, attribute, value in pushed(spark, schema, predicate):
        if len(attribute) != 1:
            continue
        b = found.setdefault(attribute[0], Bounds())
        if kind == "IsNull" or (kind == "EqualNullSafe" and value is None):
            b.null = True
        elif value is None or kind == "Not":
            continue
        elif kind in ("EqualTo", "EqualNullSafe"):
            b.at_least(value)
            b.at_most(value)
        elif kind in ("GreaterThan", "GreaterThanOrEqual"):
            b.at_least(value)
        elif kind in ("LessThan", "LessThanOrEqual"):
            b.at_most(value)
        elif kind == "StringStartsWith":
            b.at_least(value)
        elif kind == "In":
            values = [v for v in value if v is not None]
            if values:
                b.at_least(min(values))
                b.at_most(max(values))
    return {c: b for c, b in found.items() if b.any}

