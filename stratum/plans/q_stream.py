"""Queries for the recurring (streamed) incremental model and snapshot
(W1, W2): the streamed result must equal the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratum.plans import q_snapshot as QS
from stratum.plans.q_incremental import EV_REPLAY, EV_SPLIT, EVENTS_RUN_SQL
from stratum.plans.snapshots import SnapshotTable
from stratum.plans.store import TableStore
from stratum.plans.suite import register
from stratum.session import scratch_path, table
from stratum.streaming.incremental import land, stream_incremental, stream_snapshot


def _ts(s):
    return F.lit(s).cast("timestamp_ntz")


@register("stream_incremental", "WITH x AS (SELECT 1)" + EVENTS_RUN_SQL + """
SELECT * FROM run1 WHERE NOT EXISTS (SELECT 1 FROM run2 WHERE run2.event_id = run1.event_id)
UNION ALL SELECT * FROM run2""")
def stream_incremental_q(spark, sf):
    """Two waves of landed files (events before Jan 16; events from
    Jan 10 with new values), each consumed by one recurring run of the
    stream (one micro-batch) and merged on event_id."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "ts")
    landing = scratch_path(spark, "landing-events")
    ckpt = scratch_path(spark, "ckpt-events")
    store = TableStore(spark)
    waves = [e.filter(F.col("ts") < _ts(EV_SPLIT)),
             e.filter(F.col("ts") >= _ts(EV_REPLAY)).withColumn("value", F.col("value") + 1)]
    for wave in waves:
        # each recurring run consumes what has landed since the last one
        land(wave, landing)
        out = stream_incremental(spark, store, "daily_events", landing, e.schema,
                                 strategy="merge", unique_key="event_id", checkpoint=ckpt)
    return out


@register("stream_snapshot", "WITH " + QS.STEPS_SQL + " SELECT * FROM s2")
def stream_snapshot_q(spark, sf):
    """The two customer generations landed as change files, each
    snapshotted by one recurring run of the stream (run time from the batch
    id; no hard deletes)."""
    v1, v2 = QS.source_v1(spark, sf), QS.source_v2(spark, sf)
    landing = scratch_path(spark, "landing-customers")
    ckpt = scratch_path(spark, "ckpt-customers")
    st = SnapshotTable(TableStore(spark), "customers_snapshot", "customer_id", "updated_at",
                       hard_deletes=False, ts_type=QS.TS)
    runs = {0: QS.RUN1, 1: QS.RUN2}
    for generation in (v1, v2):
        land(generation, landing)
        out = stream_snapshot(spark, st, landing, v1.schema, lambda b: runs[b], checkpoint=ckpt)
    return out
