"""Cutting lineage: tables written to the folder all executors share.

A cut is a Parquet table under ``spark.checkpoint.dir``.  Unlike a local checkpoint it survives the loss of any
executor, and unlike ``DataFrame.checkpoint`` it is columnar, compressed and computed once.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}  # folders of local sessions without the setting
_written: dict[str, set[str]] = {}  # tables of each session that are not released yet


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset (tests, local runs) a temporary one is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        path = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="kgloom-"))
    return path.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read from there.

    An empty frame gives an empty table of the same schema.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kgloom_path = path  # for release()
    return out


def release(df: DataFrame | None) -> None:
    """Delete the table behind a frame returned by :func:`cut`, once nothing reads it any more."""
    path = getattr(df, "_kgloom_path", None)
    if path is not None:
        _delete(df.sparkSession, path)


def sweep(spark: SparkSession) -> int:
    """Delete all tables that this session has cut and not released; the number of them.  For a long-lived session, between queries whose
    results have been written: frames that read such tables can no longer be used."""
    paths = _written.pop(spark.sparkContext.applicationId, set())
    for path in paths:
        _delete(spark, path)
    return len(paths)


def _delete(spark: SparkSession, path: str) -> None:
    _written.get(spark.sparkContext.applicationId, set()).discard(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def broadcast_if_small(df: DataFrame, max_bytes: int = 2 << 20):
    """``df`` with a broadcast hint if Catalyst's size estimate proves it under ``max_bytes``; as it is otherwise.

    The estimate of a table just written by :func:`cut` is its size on disk, so it grows with the data and the plan
    falls back to a shuffled join by itself.
    """
    from pyspark.sql import functions as F

    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= max_bytes else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores: a table of fewer row groups than that is dealt out evenly before
    work that costs more than the deal.  Where the scan has partitions enough, nothing is moved; nor is a frame that joins, groups
    or deals out itself, whose partitions are not known without running it."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    if any(x in plan for x in ("Join", "Aggregate", "Exchange", "Window", "Sort", "MapInArrow")):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
