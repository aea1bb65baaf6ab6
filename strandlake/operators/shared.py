"""The folder that driver and executors share, and results that several branches of a plan read, computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is set, a temporary one serves a local session; a cluster needs its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def once(df: DataFrame) -> DataFrame:
    """``df`` computed now and written by ``checkpoint`` to the shared folder, so that no lost executor takes it along."""
    folder(df.sparkSession)
    return df.checkpoint()
