"""Small helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.session import scratch_path, shared_dir

#: White space of the text contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, always with the schema its files have now."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole(text: str) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and leaves every other character alone."""
    return F.translate(text, UPPER, LOWER)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    return f"{stem}_{uuid.uuid4().hex[:10]}"


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a row number that is unique, though not dense, in the column ``name``.

    The numbers hold for one evaluation only: Spark splits files by the number of
    cores it has then, so a second scan may number the rows otherwise.  What is
    read more than once must be ``staged`` first.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def staged(df: DataFrame, name: str, by: str | None = None, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder, in a folder for each value of ``by``, and reads it back: cuts lineage and fixes its rows."""
    path = scratch_path(df.sparkSession, name)
    out = df.write.option("compression", codec)
    (out.partitionBy(by) if by else out).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if (made := _MADE.get()) is not None:
        made.append(out)
    return out


_MADE: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables ``staged`` inside are deleted at the end, but for those given to the function that this yields.

    What is read after the end must have been staged inside and kept."""
    made, kept = [], []
    before = _MADE.set(made)
    try:
        yield lambda df: kept.append(df) or df
    finally:
        _MADE.reset(before)
        for df in made:
            if not any(df is x for x in kept):
                discard(df)
        if (outer := _MADE.get()) is not None:
            outer += kept


def discard(df: DataFrame) -> None:
    """Deletes the files of a ``staged`` table that nothing reads any more; other tables are left alone."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    root = f"{shared_dir(df.sparkSession)}/stratum/"
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path, top = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(root)
        if path.toUri().getPath().startswith(top.toUri().getPath()):
            while path.getParent().toUri().getPath() != top.toUri().getPath():   # the folder of one value
                path = path.getParent()
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each query that is made inside are deleted when it ends; else they stay until the driver happens to collect its garbage.

    A table that was made inside and is run twice is shuffled twice."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Marks that ids are hashed to: the table of those that occur has at most so many rows, whatever the data's size.
MARKS = 1 << 20


def by_mark(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` in two parts: rows that may have one of ``ids`` (its one column) as ``key``, and rows that cannot.

    Whether they may is told by a hash of MARKS values, so the broadcast table is
    bounded; with more ids than that all rows may, which costs time only.  Wide
    rows that a join would drop are thus not moved.
    """
    mark = fresh(df, "mark")
    of = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(MARKS)).cast("int")
    with shuffles_deleted(df.sparkSession):
        marks = F.broadcast(staged(ids.select(of(ids.columns[0]).alias(mark)).distinct(), "marks"))
    marked = df.withColumn(mark, F.when(F.col(key).isNotNull(), of(key)))
    return marked.join(marks, mark, "left_semi").drop(mark), marked.join(marks, mark, "left_anti").drop(mark)


def without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` is not among ``ids`` (its one column, of another name)."""
    may, cannot = by_mark(df, key, ids)
    return cannot.unionByName(may.join(ids, may[key] == ids[ids.columns[0]], "left_anti"))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Hands rows to Python in small batches, so that very long texts fit beside each other."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
