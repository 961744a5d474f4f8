"""Paths that driver and tasks read alike."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, by the session's own file system rules; without a scheme it is the default file system's."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(place).toString()


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """File system of a qualified path, and the path within it."""
    scheme, found, rest = path.partition(":/")
    if not found:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path if rest.startswith("/") else f"{scheme}:///{rest}")
