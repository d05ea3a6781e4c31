"""Session helpers."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def let_workers_import(spark: SparkSession) -> None:
    """Put this checkout on the Python path of tasks that start from now on."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qualified(spark: SparkSession, path: str) -> str:
    """path with its scheme: that of Spark's default file system if it names none."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jpath).toString().rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, with its scheme.

    Named in full, readers and writers outside of Spark find the same folder as Spark. Only a purely local session may leave the setting unset; it then gets /tmp/checkpoints.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return qualified(spark, configured)
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


def _delete(spark: SparkSession, path: str, on_exit: bool) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(jpath) if on_exit else fs.delete(jpath, True)


#: Paths handed out within the open scratch_space().
_spaces: ContextVar[list[str] | None] = ContextVar("spaces", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the scratch_space() that is open ends, or when the driver's JVM exits."""
    path = f"{shared_dir(spark)}/segspark-{name}-{uuid.uuid4().hex}"
    _delete(spark, path, on_exit=True)
    if (taken := _spaces.get()) is not None:
        taken.append(path)
    return path


@contextmanager
def scratch_space(spark: SparkSession) -> Iterator[None]:
    """A with block whose intermediate tables go when it ends, so that a driver of many queries doesn't fill the shared folder.

    Results are lazy and read these tables: collect them or write them elsewhere within the block. Blocks may be nested; each deletes its own.
    """
    taken: list[str] = []
    token = _spaces.set(taken)
    try:
        yield
    finally:
        _spaces.reset(token)
        for path in taken:
            _delete(spark, path, on_exit=False)


def stash(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet in the shared folder and return the written table.

    Cuts lineage: a lost executor costs no recomputation of what came before, and
    later plans see the table's true size when they choose a join.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._stashed_at = path
    return written


def stashed(df: DataFrame, name: str = "table") -> DataFrame:
    """df itself if stash() returned it, else what stash() makes of it."""
    return df if getattr(df, "_stashed_at", None) else stash(df, name)


def planned_bytes(df: DataFrame) -> int:
    """The size of df as the optimizer estimates it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def will_broadcast(df: DataFrame) -> bool:
    """Whether Spark broadcasts df in a join by its estimated size."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return planned_bytes(df) <= limit


def discard(*frames: DataFrame) -> None:
    """Delete tables that stash() returned, once nothing reads them any more; other frames are left alone."""
    for frame in frames:
        path = getattr(frame, "_stashed_at", None)
        if path:
            _delete(frame.sparkSession, path, on_exit=False)
