"""Folders wherever Spark can read, by Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    """A folder with all that it holds."""
    fs, where = _at(spark, path)
    fs.delete(where, True)


def uri(spark: SparkSession, path: str) -> str:
    """A path as a URI with its file system."""
    fs, where = _at(spark, path)
    full = fs.makeQualified(where).toUri().toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full
