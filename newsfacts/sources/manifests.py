"""Versions of a stored table: one numbered folder each, in force once it is whole."""

from __future__ import annotations

from pyspark.sql import SparkSession


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names directly under a folder; none where it does not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []


def versions(spark: SparkSession, path: str) -> dict[int, bool]:
    """Versions begun under ``path``/manifests, and whether their manifest is whole."""
    begun = children(spark, f"{path}/manifests")
    return {int(n): "_SUCCESS" in children(spark, f"{path}/manifests/{n}") for n in begun if n.isdigit()}
