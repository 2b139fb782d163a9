"""Schema drift, contracts and REQUIRED checks (E8, E9, E10) as DataFrames.

Comparing declared and actual schemas is metadata work (column lists, on the
driver, tiny).  What the data says -- how many non-NULL values an undeclared
column holds, how many values of a mistyped column do not convert, how many
NULLs sit in a REQUIRED column, how many unique-key values repeat -- is one
aggregate per table (a single scan, partial aggregation), and the report rows
are emitted from that one-row aggregate with ``inline``; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.types import Field, canonical_of, declared_type, spark_type

REPORT_SCHEMA = "table_name string, column_name string, kind string, declared_type string, " \
                "actual_type string, affected_rows bigint"


def _row(table: str, column: str, kind: str, declared, actual, affected: Column | None) -> Column:
    return F.struct(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
                    F.lit(kind).alias("kind"), F.lit(declared).cast("string").alias("declared_type"),
                    F.lit(actual).cast("string").alias("actual_type"),
                    (affected if affected is not None else F.lit(None)).cast("bigint")
                    .alias("affected_rows"))


def _uncastable(df: DataFrame, col: str, to: T.DataType) -> Column:
    """Values that do not cast to the declared type: all that are not NULL
    where Spark has no cast between the two types."""
    c = F.col(f"`{col}`")
    try:
        df.select(c.try_cast(to)).schema
    except AnalysisException:
        return F.count(c)
    return F.count_if(c.isNotNull() & c.try_cast(to).isNull())


def drift(table: str, df: DataFrame, declared: list[Field]) -> DataFrame:
    """E8 for one table: extra / missing / type_mismatch rows."""
    actual = {f.name.lower(): f for f in df.schema}
    decl = {f.name.lower(): f for f in declared}
    aggs: dict[str, Column] = {}
    rows = []
    for f in declared:
        a = actual.get(f.name.lower())
        if a is None:
            rows.append(("missing", f.name, f.canonical, None, None))
            continue
        at = declared_type(a)
        if at != f.canonical:
            k = f"m{len(aggs)}"
            aggs[k] = _uncastable(df, a.name, spark_type(f))
            rows.append(("type_mismatch", f.name, f.canonical, at, k))
    for a in df.schema:
        if a.name.lower() not in decl:
            k = f"m{len(aggs)}"
            aggs[k] = F.count(F.col(f"`{a.name}`"))
            rows.append(("extra", a.name, None, declared_type(a), k))
    spark = df.sparkSession
    if not rows:
        return spark.createDataFrame([], REPORT_SCHEMA)
    base = df.agg(*[v.alias(k) for k, v in aggs.items()]) if aggs else spark.range(1)
    structs = [_row(table, col, kind, d, a, F.col(k) if k else None)
               for kind, col, d, a, k in rows]
    return base.select(F.inline(F.array(*structs)))


def drift_report(tables: dict[str, tuple[DataFrame, list[Field]]]) -> DataFrame:
    """E8 over many tables: one report."""
    parts = [drift(name, df, decl) for name, (df, decl) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


CONTRACT_SCHEMA = "check string, column_name string, detail string, violations bigint"


def _check(check: str, column: str, detail, violations: Column | None) -> Column:
    return F.struct(F.lit(check).alias("check"), F.lit(column).alias("column_name"),
                    F.lit(detail).cast("string").alias("detail"),
                    (violations if violations is not None else F.lit(None)).cast("bigint")
                    .alias("violations"))


def duplicate_keys(df: DataFrame, unique_key: list[str]) -> DataFrame:
    """Key values (NULL-free) that occur more than once.  Partial
    aggregation collapses a hot key to one row per task before the shuffle."""
    return (df.dropna(subset=unique_key).groupBy(*unique_key).count()
            .filter(F.col("count") > 1).drop("count"))


def contract(df: DataFrame, declared: list[Field], unique_key: list[str] | None = None,
             partition_by: list[str] | None = None, cluster_by: list[str] | None = None) -> DataFrame:
    """Contract report of a model's output against its declared schema.

    Checks: undeclared column, missing column (REPEATED exempt), type
    mismatch (with the count of values that do not convert), NULLs in
    REQUIRED columns, repeated unique-key values, and unique key / partition
    / cluster columns that do not exist.  Columns being added
    (``alter='insert'``) are skipped.
    """
    actual = {f.name.lower(): f for f in df.schema}
    decl = [f for f in declared if f.alter != "insert"]
    names = {f.name.lower() for f in declared}
    aggs: dict[str, Column] = {}
    rows = []

    def agg(c: Column) -> str:
        k = f"c{len(aggs)}"
        aggs[k] = c
        return k

    for a in df.schema:
        if a.name.lower() not in names:
            rows.append(("undeclared_column", a.name, declared_type(a), None))
    for f in decl:
        a = actual.get(f.name.lower())
        if a is None:
            if not f.repeated:
                rows.append(("missing_column", f.name, f.canonical, None))
            continue
        at = declared_type(a)
        if at != f.canonical:
            rows.append(("type_mismatch", f.name, f"{f.canonical} <> {at}",
                         agg(_uncastable(df, a.name, spark_type(f)))))
        if f.mode == "REQUIRED":
            rows.append(("required_null", f.name, None,
                         agg(F.count_if(F.col(f"`{a.name}`").isNull()))))
    for role, cols in (("unique_key", unique_key), ("partition_by", partition_by),
                       ("cluster_by", cluster_by)):
        for c in cols or []:
            if c.lower() not in actual:
                rows.append((f"missing_{role}_column", c, None, None))
    dup_col = None
    if unique_key and all(k.lower() in actual for k in unique_key):
        dup_col = duplicate_keys(df, [actual[k.lower()].name for k in unique_key]) \
            .agg(F.count(F.lit(1))).scalar()
        rows.append(("duplicate_key", ",".join(unique_key), None, "__dup"))
    spark = df.sparkSession
    if not rows:
        return spark.createDataFrame([], CONTRACT_SCHEMA)
    base = df.agg(*[v.alias(k) for k, v in aggs.items()]) if aggs else spark.range(1)
    structs = []
    for check, col, detail, k in rows:
        v = dup_col if k == "__dup" else (F.col(k) if k else None)
        structs.append(_check(check, col, detail, v))
    return base.select(F.inline(F.array(*structs)))


def required_nulls(df: DataFrame, declared: list[Field]) -> DataFrame:
    """NULL count per REQUIRED column, one row each, from one scan."""
    req = [f for f in declared if f.mode == "REQUIRED"]
    have = {c.lower(): c for c in df.columns}
    if not req:
        return df.sparkSession.createDataFrame([], "column_name string, null_rows bigint")
    base = df.agg(*[F.count_if(F.col(f"`{have[f.name.lower()]}`").isNull()).alias(f"n{i}")
                    for i, f in enumerate(req)])
    return base.select(F.inline(F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), F.col(f"n{i}").alias("null_rows"))
        for i, f in enumerate(req)])))


def enforce_required(df: DataFrame, declared: list[Field]) -> DataFrame:
    """E10 on write: a task fails on the first NULL in a REQUIRED column
    (Spark does not enforce NOT NULL on parquet writes)."""
    req = [f.name for f in declared if f.mode == "REQUIRED"]
    if not req:
        return df
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in req])
    msg = f"NULL in REQUIRED column(s) {req}"
    return df.filter(F.assert_true(ok, F.lit(msg)).isNull())
