"""Tables in the folder that a cluster's executors share, to cut the lineage of iterations."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from ..errors import ScratchError

#: The setting that keeps this session's folder.
_OWN = "spark.loomgraph.scratch"
#: The setting that removes a query's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The settings of the largest table that is broadcast, and what they are at most while a table is written.
_BROADCAST, BROADCAST_BYTES = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"), 256 << 10


def shared_dir(spark: SparkSession) -> str:
    """A folder of this session in the one that the cluster names in spark.checkpoint.dir; it is removed at exit.

    Only where that is unset and all runs on one machine, as in tests, is it a
    temporary folder.
    """
    if (at := spark.conf.get(_OWN, None)) and at.startswith(spark.conf.get("spark.checkpoint.dir", None) or at):
        return at
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ScratchError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
    at = f"{base.rstrip('/')}/loomgraph-{uuid.uuid4().hex}"
    spark.conf.set(_OWN, at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def remove() -> None:
        # the session may be gone by then, and its folder with it
        with contextlib.suppress(Exception):
            system.delete(path, True)

    atexit.register(remove)
    return at


_scopes = threading.local()


@contextlib.contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes at its end what save() has written inside, but for tables given to the function that it yields."""
    stack: list[dict[int, tuple[DataFrame, str]]] = _scopes.__dict__.setdefault("stack", [])
    mine, kept = {}, set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(id(df))
        return df

    stack.append(mine)
    try:
        yield keep
    finally:
        stack.pop()
        for key, (df, path) in mine.items():
            if key not in kept:
                at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
            elif stack:
                stack[-1][key] = (df, path)


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Sets these for a while, and then as they were."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _small_broadcasts(spark: SparkSession) -> dict[str, str]:
    """The settings of broadcasts, no larger than BROADCAST_BYTES or than they are."""
    size = lambda text: spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text)
    known = {k: v for k in _BROADCAST if (v := spark.conf.get(k, None)) is not None}
    return {k: str(min(BROADCAST_BYTES, size(v))) if not v.startswith("-") else v for k, v in known.items()} | ({} if known else {_BROADCAST[0]: str(BROADCAST_BYTES)})


def save(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again.

    This cuts the lineage, and a lost executor costs none of it. Nothing reads the
    write's shuffle files again, so they go at its end, not when the driver's next
    full collection finds them. zstd keeps texts to about half of what the default
    takes. Sizes of tables and shuffles are known compressed, and a search has dozens
    of joins, so only what is very small goes through the driver.
    """
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}/{tag}"
    with _settings(df.sparkSession, {_CLEANUP: "true"} | _small_broadcasts(df.sparkSession)):
        df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    if stack := getattr(_scopes, "stack", None):
        stack[-1][id(table)] = (table, path)
    return table
