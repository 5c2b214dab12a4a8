"""The folder that driver and executors share, and what is kept there for a while."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (local mode only), a new one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return named or held.get()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="framelake-")
    sc.setCheckpointDir(named)
    return named


def kept(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, so that a lost executor costs no more than a read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def with_folder(spark: SparkSession, made: Callable[[str], DataFrame]) -> DataFrame:
    """What `made` reads from a new shared folder, which goes afterwards."""
    path = f"{shared_dir(spark).removeprefix('file://').removeprefix('file:').rstrip('/')}/files-{uuid.uuid4().hex}"
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(fs)
    try:
        return kept(made(path))
    finally:
        remove(spark, path)
