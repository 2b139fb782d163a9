"""External file tables (S3) and inline rows.

CSV with one leading line uses the reader's ``header`` option and stays
splittable.  With more leading lines, or with line feeds in quoted fields, the
files are read as lines and put together to records by ``records``, which keeps
them splittable too; ``from_csv`` parses the records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("CSV", "JSON", "PARQUET", "ORC", "AVRO")


class ExternalConfigError(ValueError):
    pass


def read_external(spark: SparkSession, uris: list[str], source_format: str = "CSV",
                  schema: T.StructType | str | None = None, autodetect: bool = False,
                  skip_leading_rows: int = 0, options: dict | None = None,
                  quoted_newlines: bool = False) -> DataFrame:
    """S3.  ``quoted_newlines``: quoted CSV fields may hold line feeds (with more
    than one leading line they always may); files are split all the same."""
    if isinstance(uris, str):
        uris = [uris]
    if not uris:
        raise ExternalConfigError("an external table needs at least one source URI")
    fmt = source_format.upper()
    if fmt not in FORMATS:
        raise ExternalConfigError(f"source format must be one of {FORMATS}")
    if fmt != "CSV":
        r = spark.read.format(fmt.lower()).options(**(options or {}))
        if schema is not None:
            r = r.schema(schema)
        return r.load(uris)
    if skip_leading_rows < 0:
        raise ExternalConfigError("skip_leading_rows must be >= 0")
    if skip_leading_rows <= 1 and not quoted_newlines:
        r = spark.read.options(**(options or {})).option("header", skip_leading_rows == 1)
        if schema is not None:
            r = r.schema(schema)
        elif autodetect:
            r = r.option("inferSchema", True)
        return r.csv(uris)
    if schema is None:
        raise ExternalConfigError("skipping more than one leading row, or quoted line feeds, need an explicit schema")
    ddl = schema if isinstance(schema, str) else schema.simpleString()[len("struct<"):-1] \
        .replace(":", " ")
    own = {k: v for k, v in (options or {}).items() if k.lower() not in ("header", "multiline")}
    given = {k.lower(): v for k, v in own.items()}
    found = records(spark, uris, skip_leading_rows, given.get("quote", '"'), given.get("escape", "\\"))
    parsed = found.select(F.from_csv(F.col("value"), ddl, own).alias("r"))
    return parsed.select("r.*")


#: Columns of a line: its place, the quotes before it in its split, its own, and the last line
#: before or at it that starts a record if the split starts outside (0) or inside (1) quotes.
LINE = "value string, file string, split long, line long, before int, own int, start0 long, start1 long"


def records(spark: SparkSession, uris: list[str], skip: int = 0, quote: str = '"', escape: str = "\\") -> DataFrame:
    """The records (value) of CSV files, whose quoted fields may hold line feeds,
    without each file's first ``skip`` lines and without blank records.

    A line starts a record if the number of quotes before it in its file is
    even.  Tasks count quotes line by line within their splits, without moving
    a line; one row a split then carries the parity, and the last record start,
    over to the next splits of its file.  A line that starts a record and has an
    even number of quotes is that record; only the lines of records with line
    feeds are shuffled, to their record.

    A quote counts unless ``escape`` stands before it (two in a row, the usual
    way to write one, leave the parity alone).  Quotes within fields that are not
    quoted must be escaped.  Lines end at a line feed, a carriage return before
    it goes with it.  A quoted field that never ends takes the rest of its file.
    """
    counted = None if escape == quote or not escape else "\\" + escape if not escape.isalnum() else escape

    def quotes(lines: pa.Array) -> np.ndarray:
        if counted:
            lines = pc.replace_substring_regex(lines, counted + ".", "")
        return pc.count_substring(lines, quote).to_numpy(zero_copy_only=False).astype(np.int32)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, line, before, starts = None, 0, 0, [-1, -1]
        for b in batches:
            if not b.num_rows:
                continue
            files, splits = b.column("file").to_numpy(zero_copy_only=False), b.column("split").to_numpy()
            # The lines of a split follow each other, in order.
            cuts = [0, *(np.flatnonzero((files[1:] != files[:-1]) | (splits[1:] != splits[:-1])) + 1).tolist(), len(files)]
            for low, high in zip(cuts, cuts[1:]):
                part = b.slice(low, high - low)
                if at != (files[low], int(splits[low])):
                    at, line, before, starts = (files[low], int(splits[low])), 0, 0, [-1, -1]
                leave = max(0, min(len(part), skip - line)) if at[1] == 0 else 0
                line += leave
                part = part.slice(leave)
                if not part.num_rows:
                    continue
                own = quotes(part.column("value"))
                parity = (before + np.cumsum(own) - own) % 2
                number = line + np.arange(len(own), dtype=np.int64)
                last = [np.maximum.accumulate(np.where(parity == h, number, starts[h])) for h in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("value"), part.column("file"), part.column("split"), pa.array(number), pa.array(parity.astype(np.int32)),
                                                  pa.array(own % 2), *map(pa.array, last)], [c.split()[0] for c in LINE.split(", ")])
                line += len(own)
                before = int(before + own.sum()) % 2
                starts = [int(x[-1]) for x in last]

    text = spark.read.option("lineSep", "\n").text(uris)
    lines = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")).mapInArrow(of, LINE)
    splits = lines.groupBy("file", "split").agg(F.sum("own").alias("quotes"), F.max("start0").alias("s0"), F.max("start1").alias("s1"))
    # One row a split of one file.
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    start = F.when(F.col("inside") == 0, F.col("s0")).otherwise(F.col("s1"))
    splits = splits.withColumn("here", F.when(start >= 0, F.struct(F.col("split").alias("split"), start.alias("line"))))
    splits = splits.select("file", "split", "inside", F.last("here", ignorenulls=True).over(earlier).alias("open"))
    placed = lines.join(splits, ["file", "split"])
    inside = (F.col("before") + F.col("inside")) % 2
    started = F.when(F.col("inside") == 0, F.col("start0")).otherwise(F.col("start1"))
    placed = placed.select("value", "file", "split", "line", ((inside == 0) & (F.col("own") == 0)).alias("whole"),
                           F.when(started >= 0, F.struct(F.col("split").alias("split"), started.alias("line"))).otherwise(F.col("open")).alias("record"))
    ordered = F.array_sort(F.collect_list(F.struct("split", "line", "value")))
    several = placed.filter("NOT whole").groupBy("file", "record").agg(F.array_join(F.transform(ordered, lambda x: x["value"]), "\n").alias("value"))
    every = placed.filter("whole").select("value").unionByName(several.select("value"))
    return every.select(F.regexp_replace("value", "\r$", "").alias("value")).filter(F.rlike("value", F.lit(r"\S")))


def inline_rows(spark: SparkSession, rows: list[dict], schema: T.StructType | None = None) -> DataFrame:
    """S4 for literal rows: ``inline(array(named_struct(...), ...))``."""
    if not rows:
        raise ValueError("inline rows need at least one row")
    names = list(rows[0])
    structs = [F.struct(*[_lit(r.get(n)).alias(n) for n in names]) for r in rows]
    out = spark.range(1).select(F.inline(F.array(*structs)))
    return out.to(schema) if schema is not None else out


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)
