"""Tables written to the folder that driver and executors share, and their removal."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of this process that still stand, oldest first.
_STANDING: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """Return the folder that ``spark.checkpoint.dir`` names; only a local session may do without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file:///tmp/checkpoints/{os.getpid()}"
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """Return the path of a folder for ``name``, which goes when the session's JVM ends, if not before."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    system, target = _at(spark, path)
    system.mkdirs(target)
    system.deleteOnExit(target)
    _STANDING.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and return the table read back, so that what comes after can't see it made differently twice."""
    path = new_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder; one that is gone already is no error."""
    system, target = _at(spark, path)
    system.delete(target, True)
    if path in _STANDING:
        _STANDING.remove(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Remove at its end all folders written within; results must be consumed by then."""
    before = set(_STANDING)
    try:
        yield
    finally:
        for path in [p for p in _STANDING if p not in before]:
            delete(spark, path)


def _at(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target
