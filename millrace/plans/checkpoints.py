"""Cutting lineage with tables written to storage that every executor can reach."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session in which neither the setting nor an earlier call named one (as in tests) gets a temporary folder;
    on a cluster that is an error, as executors would not see the driver's folder.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-checkpoint-"))
        known = sc._jsc.sc().getCheckpointDir()
    return known.get()


def cut(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs start there, whatever executors are lost.

    ``tidy`` lets the driver collect its garbage after that, upon which Spark deletes the shuffle files of what is written;
    for large tables only.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if tidy:
        gc.collect()
        df.sparkSession._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def small(df: DataFrame, rows: int = 4_000_000) -> DataFrame:
    """A written table of few columns, marked for broadcast if it has few enough rows (some tens of MB); beyond that a join
    with it stays a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def release(df: DataFrame) -> None:
    """Delete the table behind a frame returned by :func:`cut`; for frames that no later job reads."""
    jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(df._millrace_path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
