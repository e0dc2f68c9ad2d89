"""Cuts of lineage that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session that names none gets an own one."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tamarisk-"))
    return sc._jsc.sc().getCheckpointDir().get()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has yet; what is written there goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def written(path: str, spark: SparkSession) -> str:
    """Names, sizes and times of the files under a path: what is derived from them is stale when this differs."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files, found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return "\n".join(sorted(found))


def cut(frame: DataFrame) -> DataFrame:
    """Lineage cut by a reliable checkpoint in the session's shared folder."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint()


def rewritten(frame: DataFrame) -> DataFrame:
    """Rows written to the shared folder and read again.

    A checkpoint keeps its plan's estimate of its size. A loop that joins its own results multiplies estimates every round, and after a
    dozen planning with such numbers takes longer than the work. Of files the size is known.
    """
    path = fresh_folder(frame.sparkSession, "rewritten")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
