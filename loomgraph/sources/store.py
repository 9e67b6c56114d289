"""Scans and graphs kept as Parquet, by project, and extraction results by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def save_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame] | None:
    """The tables below folder, or none if one is missing or can't be read."""
    if not all(exists(spark, f"{folder}/{name}/_SUCCESS") for name in names):
        return None
    try:
        return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
    except Exception:  # a corrupt store is a cold one
        return None


def content_hash(content) -> F.Column:
    return F.sha2(content, 256)


class ExtractionCache:
    """Extraction results by content hash and path.

    The path is part of the key: results hold ids that name their file, so equal
    contents at two paths must not share one.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _known(self) -> DataFrame | None:
        return self.spark.read.parquet(self.folder) if exists(self.spark, f"{self.folder}/_SUCCESS") else None

    def partition(self, files: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        """(results at hand, files that have none)."""
        known, hashed = self._known(), files.withColumn("hash", content_hash(F.col("content")))
        if known is None:
            return None, hashed
        keys = ["hash", "relative"]
        return known.join(hashed.select(*keys), keys, "left_semi"), hashed.join(known.select(*keys).distinct(), keys, "left_anti")

    def put(self, results: DataFrame) -> None:
        """results: hash, relative and what extraction gave."""
        results.write.mode("append").parquet(self.folder)
