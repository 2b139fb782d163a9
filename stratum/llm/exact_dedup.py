"""Exact dedup against a persistent digest index.

The index is a Parquet table in the shared folder, bucketed and sorted by
digest.  A batch is reduced to one candidate per digest (partial aggregates, so
a text that a third of all rows share costs one row per task), the candidates
are anti-joined to the index by sort-merge, and what is new is appended.  The
index side of that join is read bucket by bucket and never shuffled.

Two texts are equal when they are identical without the characters
space and \\t-\\r; the digest is SHA-256 of what is left.  Of equal texts the
one with the most code points stays, then the smallest id (null ids last); of
rows that tie in both, any one.  Texts that are null count as empty, and all
empty texts are equal.  An empty batch adds nothing and decides nothing.

A batch may be run again under its name, in any split of its rows and after an
append that ended half way: the index only says which batch brought a digest,
and which of a batch's rows stays follows from the rows themselves.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.common import WHITE, fresh, numbered, shuffles_deleted, staged, temporary, whole, without
from stratum.session import scratch_path

DIGEST = "text_sha256"
#: Session settings: where an index lies that outlives a run, and under which name a run's rows enter it.
INDEX_SETTING, BATCH_SETTING = "spark.stratum.digestIndex", "spark.stratum.digestBatch"


class DigestIndex:
    """The kept digests at ``path``: (text_sha256, keep_id, batch), one row per digest.

    The path is the caller's: one that stays makes later batches lose what earlier ones brought."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = "digest_index_" + hashlib.md5(path.encode()).hexdigest()[:16]
        spark.sql(f"""CREATE TABLE IF NOT EXISTS {self.table}
            ({DIGEST} STRING, keep_id BIGINT, batch STRING)
            USING parquet CLUSTERED BY ({DIGEST}) SORTED BY ({DIGEST}) INTO {buckets} BUCKETS
            LOCATION '{path}'""")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, candidates: DataFrame) -> None:
        """Adds the candidates whose digest the index lacks."""
        known = self.read().select(DIGEST).hint("merge")
        new = candidates.join(known, DIGEST, "left_anti").repartition(self.buckets, DIGEST)
        new.select(DIGEST, "keep_id", "batch").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)


def decide(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text", number: str | None = None) -> DataFrame:
    """One row per row of ``docs``: row (see ``numbered``; a column ``number`` of ``docs`` is taken instead), id, keep_id, group_size (rows of this batch with that text), kept, text_sha256."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.col(n).alias("row") for n in [number] if n])
    rows = rows if number else numbered(rows, "row")
    rows = staged(rows.select("row", "id", F.char_length(whole("text")).alias("chars"), F.sha2(F.translate(whole("text"), WHITE, ""), 256).alias(DIGEST)), "digests")
    best = F.min(F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("no_id"), "id", "row")).alias("best")
    groups = rows.groupBy(DIGEST).agg(F.count(F.lit(1)).alias("group_size"), best)
    index.append(groups.select(DIGEST, F.col("best.id").alias("keep_id"), F.lit(batch).alias("batch")))
    # Written, so that both sides of the last join are plain exchanges and a hot digest is split at run time.
    entries = staged(groups.select(DIGEST, "group_size", F.col("best.row").alias("best_row")).join(index.read().hint("merge"), DIGEST), "entries")
    kept = (F.col("batch") == batch) & (F.col("best_row") == F.col("row"))
    return rows.join(entries, DIGEST).select("row", "id", "keep_id", "group_size", kept.alias("kept"), DIGEST)


def index_of(spark: SparkSession) -> tuple[DigestIndex, str]:
    """The index and batch that the session names in INDEX_SETTING and BATCH_SETTING; without them, an index of its own."""
    path = spark.conf.get(INDEX_SETTING, None)
    return DigestIndex(spark, path or scratch_path(spark, "index")), spark.conf.get(BATCH_SETTING, None) or "first"


def kept_rows(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.  Only rows that may go move, by row number, which no text can skew."""
    row = fresh(docs, "row")
    rows = staged(numbered(docs, row), "numbered")
    with shuffles_deleted(docs.sparkSession), temporary() as kept:
        gone = kept(staged(decide(rows, index, batch, id_col, text_col, row).filter("NOT kept").select(F.col("row").alias(fresh(rows, "gone"))), "gone"))
    return without(rows, row, gone).select(*docs.columns)
