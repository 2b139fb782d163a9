"""Grouped aggregates that follow their input by increments (K3).

``MergeableAggregate`` splits SUM, COUNT, MIN, MAX and AVG into a state per group
that merges: the state of all rows is the merged states of parts of them.  So a
stored mart takes in the rows that its input gained without reading the others.

Rows that the input lost are taken back where that is exact: every measure is a
COUNT, or a SUM or AVG of whole numbers or decimals.  A state then keeps how many
rows a group has and how many values stand in a sum, so that a group without
rows goes and a sum without values is NULL, as a query over all rows would say.
MIN, MAX and floating sums cannot be taken back; ``retractable`` says so.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.functions.util import as_col

KINDS = ("sum", "count", "min", "max", "avg")
#: Columns of the state that a mart does not show.
ROWS, HIDDEN = "__rows", "__"


@dataclass
class Measure:
    """``kind`` of ``value`` (a column, or its name); a count without a value counts rows."""

    kind: str
    value: Column | str | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"a measure is one of {KINDS}, not {self.kind!r}")
        if self.value is None and self.kind != "count":
            raise ValueError(f"{self.kind} needs a value")


class MergeableAggregate:
    def __init__(self, keys: list[str], measures: dict[str, Measure | tuple]):
        self.keys = list(keys)
        self.measures = {n: m if isinstance(m, Measure) else Measure(*m) for n, m in measures.items()}
        clash = [n for n in [*self.keys, *self.measures] if n.startswith(HIDDEN)] + [n for n in self.measures if n in self.keys]
        if clash:
            raise ValueError(f"names {clash} are taken twice or start with {HIDDEN!r}")

    @property
    def columns(self) -> list[str]:
        """What a mart shows."""
        return [*self.keys, *self.measures]

    def described(self) -> str:
        """Text that changes with the definition."""
        return str([self.keys, [(n, m.kind, str(m.value)) for n, m in self.measures.items()]])

    def _sums(self) -> list[str]:
        return [n for n, m in self.measures.items() if m.kind in ("sum", "avg")]

    def state(self, rows: DataFrame) -> DataFrame:
        """One row a group: a partial aggregate, whatever the rows are."""
        aggs = [F.count(F.lit(1)).alias(ROWS)]
        for n, m in self.measures.items():
            value = None if m.value is None else as_col(m.value)
            if m.kind == "count":
                aggs.append(F.count(F.lit(1) if value is None else value).alias(n))
            elif m.kind in ("min", "max"):
                aggs.append(getattr(F, m.kind)(value).alias(n))
            else:
                aggs += [F.sum(value).alias(f"__sum_{n}"), F.count(value).alias(f"__n_{n}")]
        return rows.groupBy(*self.keys).agg(*aggs)

    def retractable(self, state: DataFrame) -> bool:
        exact = lambda dt: isinstance(dt, (T.IntegralType, T.DecimalType))
        kinds = {m.kind for m in self.measures.values()}
        return not kinds & {"min", "max"} and all(exact(state.schema[f"__sum_{n}"].dataType) for n in self._sums())

    def negated(self, state: DataFrame) -> DataFrame:
        """The state that takes the rows of ``state`` back."""
        if not self.retractable(state):
            raise ValueError("minima, maxima and floating sums cannot be taken back")
        return state.select(*self.keys, *[(-F.col(f"`{c}`")).cast(state.schema[c].dataType).alias(c) for c in state.columns if c not in self.keys])

    def merged(self, states: list[DataFrame]) -> DataFrame:
        """The state of all rows; it has the column types of the first one."""
        like = states[0].schema
        every = states[0]
        for s in states[1:]:
            every = every.unionByName(s.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in like]))
        aggs = []
        for c in like.names:
            if c not in self.keys:
                kind = self.measures[c].kind if c in self.measures else "sum"
                aggs.append(getattr(F, kind if kind in ("min", "max") else "sum")(F.col(f"`{c}`")).cast(like[c].dataType).alias(c))
        out = every.groupBy(*self.keys).agg(*aggs)
        return out.filter(F.col(ROWS) > 0)

    def finished(self, state: DataFrame) -> DataFrame:
        """The state with the shown measures, in their order, before the hidden columns."""
        shown = []
        for n, m in self.measures.items():
            total, count = f"__sum_{n}", f"__n_{n}"
            if m.kind == "sum":
                shown.append(F.when(F.col(count) > 0, F.col(total)).alias(n))
            elif m.kind == "avg":
                shown.append(F.when(F.col(count) > 0, F.col(total) / F.col(count)).cast("double").alias(n))
            else:
                shown.append(F.col(f"`{n}`"))
        return state.select(*self.keys, *shown, *[c for c in state.columns if c.startswith(HIDDEN)])

    def unfinished(self, mart: DataFrame) -> DataFrame:
        """The state that a finished mart holds."""
        return mart.drop(*self._sums())
