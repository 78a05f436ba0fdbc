"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the checkpoint folder that is set; a temporary one only where driver and executors are one machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="veilframe-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/veilframe-{name}-{uuid.uuid4().hex}"


def kept(frame: DataFrame, name: str = "kept") -> DataFrame:
    """The same rows, written once to the shared folder and read from there: columns take less room than a checkpoint's rows."""
    at = scratch(frame.sparkSession, name)
    frame.write.parquet(at)
    return frame.sparkSession.read.schema(frame.schema).parquet(at)


def cut(frame: DataFrame) -> DataFrame:
    """The same rows read from a reliable checkpoint."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)
