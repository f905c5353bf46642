"""Folders on the file system Spark writes to: listing and removing."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    system, where = _at(spark, folder)
    if not system.exists(where):
        return []
    return [s.getPath().getName() for s in system.listStatus(where)]


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files in a folder."""
    system, where = _at(spark, path)
    return system.getContentSummary(where).getLength()


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file, or a folder with all in it, if it is there."""
    system, where = _at(spark, path)
    system.delete(where, True)
