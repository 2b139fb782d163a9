"""Recurring incremental models and snapshots as Structured Streaming jobs
(W1, W2).

New input files are picked up by a file stream; ``foreachBatch`` applies the
model's strategy (merge / delete+insert / append) or a snapshot run to each
micro-batch and commits a new table version.  The streaming checkpoint (in the
shared folder) records which files each batch covered.  The batch id is part of
the pointer update that commits the batch's data, so a batch replayed after a
failure at any point is either applied or skipped, never applied twice.

The result does not depend on how files are cut into batches: with ``order_by``
a merge keeps each key's greatest row of table and batch; without it a batch
that repeats a key is refused, as which row wins would be chance.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from stratum.operators import layout, strategies
from stratum.plans.increment import apply_increment
from stratum.plans.snapshots import SnapshotTable
from stratum.plans.store import TableStore
from stratum.session import checkpoint as cut
from stratum.session import scratch_path

BATCH_ID = "batch_id"


def last_batch(store: TableStore, name: str) -> int:
    """Id of the last micro-batch committed to a table; -1 if there is none."""
    got = store.property(name, BATCH_ID)
    return -1 if got is None else int(got)


def stream_incremental(spark: SparkSession, store: TableStore, name: str, input_path: str,
                       schema, strategy: str = "merge", unique_key=None,
                       fmt: str = "parquet", max_files_per_trigger: int | None = None,
                       checkpoint: str | None = None,
                       transform: Callable[[DataFrame], DataFrame] | None = None,
                       order_by: str | None = None, partition_by=None,
                       cluster_by: list[str] | None = None, **options) -> DataFrame:
    """Apply an incremental strategy to every micro-batch of new files;
    runs until the available input is consumed (``availableNow``).  The rest is
    as for ``batch_writer``."""
    apply = batch_writer(store, name, strategy, unique_key, transform, order_by, partition_by,
                         cluster_by, **options)
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    q = (reader.load(input_path).writeStream.foreachBatch(apply)
         .option("checkpointLocation", checkpoint or scratch_path(spark, f"ckpt-{name}"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return store.read(name)


def batch_writer(store: TableStore, name: str, strategy: str = "merge", unique_key=None,
                 transform: Callable[[DataFrame], DataFrame] | None = None,
                 order_by: str | None = None, partition_by=None,
                 cluster_by: list[str] | None = None, require_partition_filter: bool = False,
                 column_comments: dict[str, str] | None = None, on_schema_change: str = "fail"):
    """The ``foreachBatch`` function of W1: apply the strategy to the batch
    and commit data and batch id at once, unless the batch was committed.

    ``partition_by`` (a partitioning of ``operators.layout``) and ``cluster_by``
    lay the table out when the first batch creates it; later batches keep the
    table's layout and rewrite only the partitions they touch.

    Keys that a batch repeats: with ``order_by``, a merge keeps the greatest row
    of table and batch and delete+insert the batch's greatest; insert_only keeps
    what the table has, else the batch's greatest.  Without it they raise.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= last_batch(store, name):
            return
        rows = transform(batch) if transform else batch
        part_cols: list[str] = []
        if partition_by is not None:
            rows, part_cols = layout.apply_partitioning(rows, partition_by)
        extra = {BATCH_ID: batch_id}
        if strategy != "append":
            rows = cut(rows)
            if order_by is not None:
                rows = strategies.newest(rows, unique_key, order_by)
            else:
                strategies.require_unique(rows, unique_key)
        if not store.exists(name):
            store.write(name, rows, partition_by=part_cols or None, cluster_by=cluster_by,
                        require_partition_filter=require_partition_filter,
                        column_comments=column_comments, extra=extra | layout.described(partition_by))
            return
        apply_increment(store, name, rows, strategy, unique_key,
                        on_duplicate="newest" if order_by is not None else "keep",
                        order_by=order_by, on_schema_change=on_schema_change, extra=extra)
    return apply


def stream_snapshot(spark: SparkSession, snapshot: SnapshotTable, input_path: str, schema,
                    run_ts_of: Callable[[int], object] | None = None, fmt: str = "parquet",
                    max_files_per_trigger: int | None = None,
                    checkpoint: str | None = None) -> DataFrame:
    """A snapshot run per micro-batch of change files, which may hold any
    number of versions of a key.  The run time comes from the batch id; without
    ``run_ts_of`` versions are valid from their own version times, and the
    result is the same for any batching that keeps each key's changes in order.
    Hard deletes stay off (a batch is not the whole source)."""
    if snapshot.hard_deletes:
        raise ValueError("a streamed snapshot cannot use hard deletes")
    apply = snapshot_writer(snapshot, run_ts_of)
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    q = (reader.load(input_path).writeStream.foreachBatch(apply)
         .option("checkpointLocation", checkpoint or scratch_path(spark, f"ckpt-{snapshot.name}"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return snapshot.read()


def snapshot_writer(snapshot: SnapshotTable, run_ts_of: Callable[[int], object] | None = None):
    """The ``foreachBatch`` function of W2."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= last_batch(snapshot.store, snapshot.name):
            return
        snapshot.run_changes(cut(batch), run_ts_of(batch_id) if run_ts_of else None,
                             {BATCH_ID: batch_id})
    return apply


def land(df: DataFrame, path: str) -> None:
    """Add one batch of new files to a landing folder (a normal parallel
    write); the next run of the stream picks up exactly those files."""
    df.write.mode("append").parquet(path)
