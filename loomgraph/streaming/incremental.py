"""A file drop as a stream, and tables that follow it file by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.imports import extract_imports, resolve_imports
from ..operators.symbols.extract import scan_files
from ..schema import FILES
from ..sources import store


class IncrementalTables:
    """Files, their symbols and their raw imports, as versions of Parquet tables.

    A batch recomputes only the files that it holds and writes the next version;
    readers use the last version that was completed, so a batch that is repeated
    after a failure does no harm.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, version: int, name: str) -> str:
        return f"{self.folder}/v{version:08d}/{name}"

    def version(self) -> int:
        """The last complete version, 0 before the first."""
        at = 0
        while store.exists(self.spark, f"{self._at(at + 1, 'done')}/_SUCCESS"):
            at += 1
        return at

    def table(self, name: str) -> DataFrame | None:
        at = self.version()
        return self.spark.read.parquet(self._at(at, name)) if at else None

    def apply(self, batch: DataFrame, batch_id: int | None = None) -> None:
        """Takes the last row (by ord) of each path in the batch for the path's file."""
        last = Window.partitionBy("relative").orderBy(F.desc("ord"))
        fresh = batch.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n").persist()
        at = self.version()
        new = {"files": fresh, "symbols": scan_files(fresh), "imports": extract_imports(fresh).withColumnRenamed("from_file", "relative")}
        for name, rows in new.items():
            if at:
                kept = self.spark.read.parquet(self._at(at, name)).join(fresh.select("relative"), "relative", "left_anti")
                rows = rows.unionByName(kept)
            rows.write.mode("overwrite").parquet(self._at(at + 1, name))
        self.spark.range(1).write.mode("overwrite").parquet(self._at(at + 1, "done"))
        fresh.unpersist()

    def import_edges(self) -> DataFrame:
        """Imports resolved against the files as they are now."""
        found = resolve_imports(self.table("imports").withColumnRenamed("relative", "from_file"), self.table("files"))
        return found.where("from_file <> to_file").select("from_file", "to_file").distinct()


def follow(spark: SparkSession, drop: str, tables: IncrementalTables, checkpoint: str) -> StreamingQuery:
    """Follows a folder to which Parquet files of schema.FILES are added, until it has caught up."""
    return (
        spark.readStream.schema(FILES).parquet(drop).writeStream.foreachBatch(tables.apply)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
