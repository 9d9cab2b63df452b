"""Tables and folders that outlive the plan that made them, where all executors
see them."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a temporary one in a
    session whose executors are the driver's own threads, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="voxelloom-")
        context.setCheckpointDir(folder)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


#: Folders made so far, for `clean`.
_made: list[str] = []


def scratch(spark: SparkSession, kind: str = "table") -> str:
    """A new folder's path in the shared folder; `clean` removes it."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and go on from there. Unlike a
    checkpoint, a table is planned by its true size: estimates of repeated joins
    multiply, checkpoint or not, until the planner runs out of memory."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Remove all folders made so far, once results that read them are written."""
    jvm, removed = spark._jvm, 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        removed += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return removed


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def write_bytes(path: str, data: bytes) -> None:
    """A small file, in whatever store, its folder made where it is missing."""
    system, place = located(path)
    if "/" in place:
        system.create_dir(place.rsplit("/", 1)[0])
    with system.open_output_stream(place, compression=None) as stream:
        stream.write(data)
