"""Intermediate results as Parquet in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where that is unset and driver and executors share a machine (tests)."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


_runs: dict[str, str] = {}


def run_folder(spark: SparkSession) -> str:
    """This application's own folder for intermediate results, removed when the driver's process ends."""
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = at = f"{shared_folder(spark)}/run-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark.sparkContext._jvm, at)
    return _runs[app]


def _remove(jvm, at: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already; the folder's name tells whose it was
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def exists(spark: SparkSession, at: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once and reads it back: later plans start from a scan, and lost executors cost nothing that was written."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
