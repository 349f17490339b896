"""Rows stored in the folder that all machines share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder's URI under spark.checkpoint.dir. Where that is unset, a temporary folder stands in on a local master; on a cluster it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "clusterloom-checkpoints")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written once and read back: cuts lineage, and a lost executor costs no more than the step that runs."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop_stored(*frames: DataFrame) -> None:
    """Deletes the folders of stored() frames that nothing reads any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
