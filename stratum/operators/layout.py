"""Table layout: time / ingest-time / integer-range partitioning (K7-K9),
clustering (K10), retention (K14) and the required partition filter (P7).

Partitioning is a derived column plus ``write.partitionBy``; Spark then prunes
directories statically (literal filters on the partition column) and
dynamically (a join against a filtered dimension).  Clustering deals rows
by ranges of the clustering columns and sorts inside each file, so that files
and row groups are skipped by their min/max statistics.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions.util import ts_literal

# Derived partition column names, and the partition id used for
# integer values outside [start, end) (NULL values get Spark's NULL partition).
TIME_PARTITION_COLUMN = "_partition_time"
INGEST_PARTITION_COLUMN = "_partition_ingest"
RANGE_PARTITION_COLUMN = "_partition_range"
RANGE_UNPARTITIONED = -9223372036854775808

GRANULARITIES = ("HOUR", "DAY", "MONTH", "YEAR")


class LayoutError(ValueError):
    pass


@dataclass
class TimePartitioning:
    """K7 / K8: by a DATE column, or a TIMESTAMP/DATETIME truncated to a
    granularity (default DAY); ``field=None`` partitions by load time."""
    field: str | None = None
    granularity: str = "DAY"
    expiration_days: float | None = None

    def __post_init__(self):
        self.granularity = self.granularity.upper()
        if self.granularity not in GRANULARITIES:
            raise LayoutError(f"granularity must be one of {GRANULARITIES}")


@dataclass
class RangePartitioning:
    """K9: integer range partitioning [start, end) in steps of ``interval``."""
    field: str
    start: int
    end: int
    interval: int

    def __post_init__(self):
        if self.interval <= 0:
            raise LayoutError("range interval must be positive")
        if self.end <= self.start:
            raise LayoutError("range end must be greater than start")


def time_bucket(c: Column, granularity: str) -> Column:
    """Partition value of a time column.  DAY/MONTH/YEAR give a DATE (so
    the value reads back as a date), HOUR gives a ``yyyyMMddHH`` id."""
    g = granularity.upper()
    if g == "HOUR":
        return F.date_format(F.date_trunc("hour", c), "yyyyMMddHH")
    if g == "DAY":
        return F.to_date(c)
    return F.to_date(F.date_trunc(g.lower(), c))


def range_bucket(c: Column, start: int, end: int, interval: int) -> Column:
    """Lower bound of the range holding ``c``; out-of-range values share one
    partition, NULL stays NULL (its own partition)."""
    lower = (F.floor((c.cast("long") - F.lit(start)) / F.lit(interval)) * F.lit(interval)
             + F.lit(start)).cast("long")
    return (F.when(c.isNull(), F.lit(None).cast("long"))
            .when((c < F.lit(start)) | (c >= F.lit(end)), F.lit(RANGE_UNPARTITIONED))
            .otherwise(lower))


def apply_partitioning(df: DataFrame, spec, run_ts: _dt.datetime | None = None):
    """Add the derived partition column; returns (df, [partition column])."""
    if isinstance(spec, RangePartitioning):
        return (df.withColumn(RANGE_PARTITION_COLUMN,
                              range_bucket(F.col(spec.field), spec.start, spec.end, spec.interval)),
                [RANGE_PARTITION_COLUMN])
    if isinstance(spec, TimePartitioning):
        if spec.field is None:
            load = ts_literal(run_ts) if run_ts else F.current_timestamp()
            return (df.withColumn(INGEST_PARTITION_COLUMN, time_bucket(load, spec.granularity)),
                    [INGEST_PARTITION_COLUMN])
        return (df.withColumn(TIME_PARTITION_COLUMN,
                              time_bucket(F.col(spec.field), spec.granularity)),
                [TIME_PARTITION_COLUMN])
    raise LayoutError(f"unknown partitioning {spec!r}")


def cluster(df: DataFrame, cols: list[str]) -> DataFrame:
    """Deal rows by ranges of up to four columns and sort inside each
    file, so that files cover disjoint ranges and the min/max statistics of
    files and row groups skip data on the clustering columns.  A hash of the
    other columns ends the order of the ranges: a hot key is split over files."""
    if not cols or len(cols) > 4:
        raise LayoutError("cluster_by takes 1 to 4 columns")
    # A hash cannot be taken of maps and variants.
    rest = [f.name for f in df.schema if f.name not in cols
            and not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    spread = [F.xxhash64(*[F.col(f"`{c}`") for c in rest])] if rest else []
    return df.repartitionByRange(*cols, *spread).sortWithinPartitions(*cols)


def described(spec) -> dict[str, str]:
    """Table properties that say which field a table is partitioned by."""
    if getattr(spec, "field", None) is None:
        return {}
    return {"partition_spec": json.dumps({"kind": type(spec).__name__} | vars(spec))}


def time_value(x) -> Column:
    """A literal of a Python time: one with a time zone is that instant, another has none."""
    if isinstance(x, _dt.datetime) and x.tzinfo is not None:
        micros = (x - _dt.datetime(1970, 1, 1, tzinfo=_dt.timezone.utc)) // _dt.timedelta(microseconds=1)
        return F.timestamp_micros(F.lit(micros).cast("long"))
    return ts_literal(x) if isinstance(x, (str, _dt.date)) else F.lit(x)


def bounds(spec_json: str, low, high) -> tuple[str, Column | None, Column | None, bool]:
    """(field, first bucket, last bucket, buckets are numbers) for field values from ``low`` to ``high``."""
    spec = json.loads(spec_json)
    if spec["kind"] == "TimePartitioning":
        bucket = lambda x: time_bucket(time_value(x).cast("timestamp_ntz"), spec["granularity"])
    else:
        # Values outside the declared range share one partition and count as its first and last bucket.
        at = lambda x: F.greatest(F.lit(spec["start"]), F.least(F.lit(x), F.lit(spec["end"] - 1)))
        bucket = lambda x: range_bucket(at(x), spec["start"], spec["end"], spec["interval"])
    return (spec["field"], None if low is None else bucket(low), None if high is None else bucket(high),
            spec["kind"] != "TimePartitioning")


def retain(df: DataFrame, partition_col: str, expiration_days: float,
           as_of: _dt.datetime) -> DataFrame:
    """Keep rows whose partition is younger than ``expiration_days`` at
    ``as_of``.  A literal filter on the partition column, so Spark prunes the
    expired directories instead of reading them."""
    if partition_col is None:
        raise LayoutError("partition expiry needs a partitioned table")
    cutoff = as_of - _dt.timedelta(days=expiration_days)
    c = F.col(partition_col)
    return df.filter(c.isNull() | (c.cast("timestamp_ntz") >= ts_literal(cutoff)))


def table_expired(expiration_time: _dt.datetime | None, as_of: _dt.datetime,
                  deletion_protection: bool = False) -> bool:
    """K14 (table level): a whole table is gone after its expiry time;
    deletion protection and an expiry are mutually exclusive."""
    if expiration_time is not None and deletion_protection:
        raise LayoutError("a table cannot have both an expiration time and deletion protection")
    return expiration_time is not None and as_of >= expiration_time


class PartitionFilterRequired(LayoutError):
    pass


def read_with_partition_filter(df: DataFrame, partition_col: str, predicate) -> DataFrame:
    """A table flagged ``require_partition_filter`` is only read with a
    predicate on its partition column; without one we refuse."""
    if predicate is None:
        raise PartitionFilterRequired(
            f"table requires a filter on partition column {partition_col!r}")
    pred = F.expr(predicate) if isinstance(predicate, str) else predicate
    if not references(df, pred, partition_col):
        raise PartitionFilterRequired(
            f"the filter does not reference partition column {partition_col!r}")
    return df.filter(pred)


def references(df: DataFrame, pred: Column, col: str) -> bool:
    """Whether the predicate refers to the column: without it, it does not
    resolve.  Text that merely names the column does not count."""
    df.select(pred).schema   # a predicate that is wrong in itself raises here
    try:
        df.withColumnRenamed(col, f"__no_{uuid.uuid4().hex}").select(pred).schema
    except AnalysisException:
        return True
    return False
