"""Row / byte statistics and scan cost.

Bytes are logical: what the values hold, whatever the files' encoding is.  A
number, date or time has a fixed width, a text its UTF-8 bytes, NULL nothing.
They are partial aggregates over the columns asked for.  ``file_stats`` gives
the bytes of the files instead, from the ``_metadata`` columns of the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# On-demand price per TiB scanned, and the bytes per GiB / MiB /
# TiB used by the cost text.
PRICE_PER_TIB = 6.25
GIB = 1_073_741_824
MIB = 1_048_576
TIB = 1_099_511_627_776


class ByteCapExceeded(RuntimeError):
    pass


def format_cost(n_bytes: int) -> str:
    """``~$0.03 (4.8 GB)``; under 0.01 GB the MB form with four decimals."""
    cost = n_bytes / TIB * PRICE_PER_TIB
    gb = n_bytes / GIB
    if gb < 0.01:
        return f"~${cost:.4f} ({n_bytes / MIB:.1f} MB)"
    return f"~${cost:.2f} ({gb:.1f} GB)"


def cost_text(n_bytes: Column) -> Column:
    """The same text as a Spark expression."""
    b = n_bytes.cast("double")
    cost = b / F.lit(TIB) * F.lit(PRICE_PER_TIB)
    return F.when(b / F.lit(GIB) < 0.01,
                  F.format_string("~$%.4f (%.1f MB)", cost, b / F.lit(MIB))) \
            .otherwise(F.format_string("~$%.2f (%.1f GB)", cost, b / F.lit(GIB)))


def logical_bytes(value: Column, dt: T.DataType) -> Column:
    """Bytes of one value: 8 for a number, date or time, 16 for a decimal, 1
    for a boolean, the length of a text or binary; nested values are summed;
    NULL is 0."""
    if isinstance(dt, (T.StringType, T.BinaryType)):
        n = F.octet_length(value).cast("long")
    elif isinstance(dt, T.StructType):
        n = sum((logical_bytes(value[f.name], f.dataType) for f in dt.fields), F.lit(0).cast("long"))
    elif isinstance(dt, T.ArrayType):
        n = F.aggregate(value, F.lit(0).cast("long"),
                        lambda total, x: total + logical_bytes(x, dt.elementType))
    elif isinstance(dt, T.MapType):
        n = (logical_bytes(F.map_keys(value), T.ArrayType(dt.keyType))
             + logical_bytes(F.map_values(value), T.ArrayType(dt.valueType)))
    else:
        n = F.lit(16 if isinstance(dt, T.DecimalType) else 1 if isinstance(dt, T.BooleanType) else 8)
    return F.when(value.isNull(), F.lit(0)).otherwise(n).cast("long")


def _logical_sum(df: DataFrame, columns: list[str]) -> Column:
    used = {c.lower() for c in columns}
    row = sum((logical_bytes(df[f"`{f.name}`"], f.dataType) for f in df.schema if f.name.lower() in used),
              F.lit(0).cast("long"))
    return F.coalesce(F.sum(row), F.lit(0).cast("long"))


def table_stats(name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """G1: rows and logical bytes of a table, per partition when
    ``partition_by`` is given (partition columns hold no bytes).  An empty
    table is one row of zeros, or no row with ``partition_by``."""
    parts = list(partition_by or [])
    own = {c.lower() for c in parts}
    data = [c for c in df.columns if c.lower() not in own]
    out = df.groupBy(*parts).agg(F.count(F.lit(1)).alias("num_rows"),
                                 _logical_sum(df, data).alias("num_bytes"))
    return out.select(F.lit(name).alias("table_name"), *parts, "num_rows", "num_bytes")


def file_stats(name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Rows, bytes and number of the files of a file-backed table, counted
    per file first (a small aggregate keyed by file), then rolled up."""
    parts = list(partition_by or [])
    per_file = (df.select(*parts, F.col("_metadata.file_path").alias("__f"),
                          F.col("_metadata.file_size").alias("__s"))
                .groupBy(*parts, "__f")
                .agg(F.count(F.lit(1)).alias("__n"), F.max("__s").alias("__s")))
    out = per_file.groupBy(*parts).agg(F.sum("__n").alias("num_rows"),
                                       F.sum("__s").alias("num_bytes"),
                                       F.count(F.lit(1)).alias("num_files"))
    return out.select(F.lit(name).alias("table_name"), *parts, "num_rows", "num_bytes", "num_files")


def scan_estimate(model: str, inputs: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """Logical bytes and price of a model from the tables it reads and the
    columns it uses, per input."""
    parts = [df.agg(_logical_sum(df, cols).alias("estimated_bytes"))
             .select(F.lit(model).alias("model"), F.lit(name).alias("input_table"), "estimated_bytes")
             for name, df, cols in inputs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("estimated_cost", cost_text(F.col("estimated_bytes")))


def input_bytes(df: DataFrame) -> int:
    """Upper bound of the bytes a plan scans: the size of its input files."""
    files = df.inputFiles()
    if not files:
        return 0
    sizes = df.sparkSession.read.format("binaryFile").load(files).select(F.sum("length"))
    return int(sizes.first()[0] or 0)


def enforce_byte_cap(df: DataFrame, max_bytes: int, name: str = "model") -> int:
    """Refuse a model whose input exceeds its byte cap, before it runs.

    The estimate is the whole input files (an upper bound of a columnar
    scan), so a model under the cap is certainly under it."""
    if max_bytes is None:
        return 0
    if max_bytes <= 0:
        raise ValueError("max_bytes_billed must be greater than 0")
    n = input_bytes(df)
    if n > max_bytes:
        raise ByteCapExceeded(f"model {name!r} would scan {n} bytes ({format_cost(n)}), "
                              f"above its cap of {max_bytes} bytes")
    return n
