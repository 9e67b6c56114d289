"""What the operators of this folder share: reading, slices of batches, SimHash bits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..sources.scratch import save, shared_dir

__all__ = ["all_columns", "bit_majority", "connected_components", "free_names", "hash_sample", "quoted", "read", "save", "shared_dir", "slices", "type_of"]

#: Rows turned into Python objects at a time, so that a batch of long texts stays small.
SLICE = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def hash_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most n rows of df, those with the least hashes of their keys.

    Rows whose hash is far above what n of them need go first, so that no task
    hands on n rows of its own. A row that repeats often may leave fewer than n.
    """
    total = df.count()
    bits = 1 << 31
    order = F.pmod(F.xxhash64(*keys), F.lit(bits))
    near = df.where(order < min(bits, math.ceil(bits * (2 * n + 200) / max(total, 1))))
    return near.orderBy(order, *keys).limit(n)


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def quoted(column: str) -> Column:
    """A column of exactly that name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def all_columns(df: DataFrame) -> list[Column]:
    return [quoted(c) for c in df.columns]


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for columns beside those of df, as like the wanted ones as can be."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def bit_majority(hashes: np.ndarray) -> int:
    """The signed 64-bit number whose bits are set in over half of the hashes.

    Each byte of a lane counts one bit, so at most 255 rows are added before the
    lanes are emptied into wide counters.
    """
    n = len(hashes)
    lanes = np.unpackbits(hashes.view(np.uint8), bitorder="little").view(np.uint64).reshape(n, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 255):
        counts += lanes[at : at + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])
