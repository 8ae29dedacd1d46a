"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local folder where it is unset and all runs in one process (tests)."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = context.applicationId
    if key not in _fallback:
        _fallback[key] = "file://" + tempfile.mkdtemp(prefix="rangeloom-")
        context.setCheckpointDir(_fallback[key])
    return _fallback[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/scratch/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> bool:
    """Delete this application's scratch tables.  Results that weren't written elsewhere can't be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage and lets several consumers share one computation; the
    files outlive any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
