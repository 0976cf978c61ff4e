"""Intermediate results as files that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or else the context's checkpoint folder.

    Where neither is named, a session of one machine (master local) gets a temporary folder; on a cluster it is
    an error, as executors could not read what others wrote into folders of their own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir (or SparkContext.setCheckpointDir) to a folder that the driver and all executors share")
        context.setCheckpointDir(Path(tempfile.mkdtemp(prefix="lexweave-")).as_uri())
        named = context.getCheckpointDir()
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes the rows as Parquet into the shared folder and reads them back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexweave-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(df: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing that is still to run reads it."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
