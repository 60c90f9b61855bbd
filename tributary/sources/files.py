"""What lies in a folder, through the file system that Spark would use for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, system = _system(spark, path)
    return system.exists(p)


def move(spark: SparkSession, pattern: str, place: Callable[[str], str]) -> None:
    """Move every path that matches to where ``place`` puts it."""
    for path in glob(spark, pattern):
        at, system = _system(spark, path)
        to, _ = _system(spark, place(path))
        system.mkdirs(to.getParent())
        system.rename(at, to)


def glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, in order; none if the folder is missing."""
    p, system = _system(spark, pattern)
    return sorted(str(s.getPath()) for s in (system.globStatus(p) or []))
