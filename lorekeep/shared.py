"""The folder that driver and executors share, and tables written there.

Everything a job keeps between steps goes to the folder that the cluster names
in ``spark.checkpoint.dir``; only where that is unset in a local session (tests) a
temporary folder is made and set. Tables are written by Spark's own writer, so a lost executor
costs a task retry and nothing else. `cleared` deletes them once a job's result is
written.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named and not context.getCheckpointDir() and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: on a cluster, driver and executors need a folder that they share")
    if not named:
        named = context.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="lorekeep-")
    named = qualified(spark, named)
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def qualified(spark: SparkSession, path: str) -> str:
    """`path` with its file system, a bare one with the cluster's default, as Spark's own writers take it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") or "/")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


@contextmanager
def cleared(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Delete what was kept between the steps inside the block, when it ends; results must be written by then, to paths in `keep` or elsewhere."""
    begin = len(_made)
    try:
        yield
    finally:
        drop(spark, *[p for p in _made[begin:] if p not in keep])


def forget(*tables: DataFrame | None) -> None:
    """Delete stored tables that no later step reads; others stay."""
    for df in tables:
        held = [p for p in _made if df is not None and any(f"/{p.rsplit("/", 1)[1]}/" in f for f in df.inputFiles())]
        if held:
            drop(df.sparkSession, *held)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables made by `new_path` that no later step reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _made.remove(path)


#: With this setting a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder (to `path`, if given) and read it back: cuts lineage, is computed once, and its shuffle files go."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)
