"""Tables that are written once in the course of a plan, so that later reads agree with each other."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="quire-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.

    Only a session whose executors are threads of the driver may do without: it gets a folder of its own, which goes
    with the process. On a cluster an unset folder is an error, since executors could not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return _own_folder()
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def new_folder(spark: SparkSession, folder: str | None = None) -> str:
    """The name of a folder that nobody has used, in the shared folder or the one given, under the application's id."""
    return f"{folder or shared_folder(spark)}/quire/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def freeze(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder, or to the one given, and read it back.

    This cuts the lineage and freezes what depends on partitioning or on an adapter's answer, so that later reads agree
    with each other after the loss of executors. The files lie under the application's id and can go when it has ended.
    """
    spark = df.sparkSession
    path = new_folder(spark, folder)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._frozen_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete what freeze has written for these frames; nothing may read them any more. Other frames are left alone."""
    for df in frames:
        path = df.__dict__.pop("_frozen_at", None)
        if path:
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
