"""Session construction and shared-folder helpers.

Everything that is written by the library (versioned tables, streaming
checkpoints, exported files) lives under one shared folder.  On a cluster that
folder is the one named by ``spark.checkpoint.dir``; we read it from the
session and only create our own (a local temp folder) when it is unset, which
happens in tests and on a laptop.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK: dict[int, str] = {}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "stratum") -> SparkSession:
    """Build (or reuse) a session configured for the library.

    AQE stays on so joins are re-planned from real shuffle sizes (broadcast
    conversion, skew splitting, partition coalescing).  Shuffle partitions
    default to the core count locally; on a cluster pass a value sized so one
    partition holds ~128-256 MB of shuffle data.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    if shuffle_partitions or (master or "").startswith("local"):
        # A cluster keeps its own setting: the driver's core count says nothing about it.
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or os.cpu_count() or 8)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for everything we write.

    Order: ``spark.checkpoint.dir`` from the session conf, then the checkpoint
    directory set on the context, then (tests only) a fresh local temp folder
    which is also installed as the checkpoint directory.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        # getCheckpointDir() returns <dir>/<uuid>; keep the parent.
        return cur.rstrip("/").rsplit("/", 1)[0]
    key = id(sc)
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if key not in _LOCAL_FALLBACK:
        d = tempfile.mkdtemp(prefix="stratum-shared-")
        sc.setCheckpointDir(d)
        _LOCAL_FALLBACK[key] = d
    return _LOCAL_FALLBACK[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared folder."""
    return f"{shared_dir(spark)}/stratum/{name}-{uuid.uuid4().hex[:12]}"


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the parquet input tables.

    The schema is read from the files each time: a replaced file may have
    other columns.
    """
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
