"""Tables written on the way: they cut the lineage, so that an action does not repeat what came before."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of our own only where none is set and all runs on one machine."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if context.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="docketlake-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


_staged: list[str] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back; the table stays until ``drop``."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession) -> None:
    """Remove the tables that this process has staged; call it when all results are stored."""
    while _staged:
        at = spark._jvm.org.apache.hadoop.fs.Path(_staged.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
