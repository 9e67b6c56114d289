"""Symbols of all files, as node and edge tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...config import DOC_EXTENSIONS
from ...sources.scratch import save
from ...sources.store import ExtractionCache, content_hash
from . import go_lang, python_lang, rust_lang, script_lang, swift_lang
from .result import Found

SCANNERS: dict[str, Callable[[str, str], Found]] = {
    "rs": rust_lang.scan, "ts": script_lang.scan_typed, "tsx": script_lang.scan_typed, "js": script_lang.scan_plain,
    "jsx": script_lang.scan_plain, "py": python_lang.scan, "go": go_lang.scan, "swift": swift_lang.scan,
}
#: Documents that a semantic extractor is given at a time.
BATCH = 20

ROWS = "hash string, relative string, nth int, is_node boolean, id string, label string, node_type string, line int, from_id string, to_id string, kind string, conf_class string, conf_score float"
_columns = [c.split()[0] for c in ROWS.split(", ")]


def _rows(hash_: str, found: Found) -> list[tuple]:
    nodes = [(hash_, found.file, i, True, *n, None, None, None, None, None) for i, n in enumerate(found.nodes)]
    return nodes + [(hash_, found.file, i, False, None, None, None, None, *e) for i, e in enumerate(found.edges)]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_columns)
    return out.astype({"nth": "Int32", "line": "Int32", "conf_score": "float32"})


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 200):
            part = pdf.iloc[at : at + 200]
            yield _frame([r for h, path, ext, text in zip(part["hash"], part["relative"], part["extension"], part["content"]) for r in _rows(h, SCANNERS[ext](text or "", path))])


def scan_files(files: DataFrame) -> DataFrame:
    """files -> ROWS: each file's nodes and edges, scanned on the executors."""
    known = files.where(F.col("extension").isin(*SCANNERS)).withColumn("hash", content_hash(F.col("content")))
    return known.select("hash", "relative", "extension", "content").mapInPandas(_scan, ROWS)


def cached_scan(files: DataFrame, cache: ExtractionCache) -> DataFrame:
    """As scan_files, but files whose content at their path has been scanned before aren't again.

    Results are added to the cache; a file without a symbol leaves none and is scanned each time.
    """
    hits, misses = cache.partition(files.where(F.col("extension").isin(*SCANNERS)))
    fresh = save(misses.select("hash", "relative", "extension", "content").mapInPandas(_scan, ROWS), "symbols")
    old = save(hits.select(*_columns), "hits") if hits is not None else None
    cache.put(fresh)
    return fresh if old is None else old.unionByName(fresh)


def semantic_rows(files: DataFrame, extractor: Callable[[list[tuple[str, str]]], list[Found]] | None) -> DataFrame:
    """ROWS that an extractor finds in documents, BATCH of them at a time; none without an extractor."""
    docs = files.where(F.col("extension").isin(*DOC_EXTENSIONS)).withColumn("hash", content_hash(F.col("content")))
    docs = docs.select("hash", "relative", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf) if extractor else 0, BATCH):
                part = pdf.iloc[at : at + BATCH]
                found = extractor(list(zip(part["relative"], part["content"])))
                yield _frame([r for h, x in zip(part["hash"], found) for r in _rows(h, x)])

    return docs.mapInPandas(run, ROWS)


def confidence_of(score: float) -> tuple[str, float]:
    """The class of a score that an extractor gives."""
    return ("Extracted", 1.0) if score >= 1 else ("Inferred", score) if score >= 0.4 else ("Ambiguous", score)


def tables(rows: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ROWS -> (nodes, edges), in the order of files and of what each holds."""
    placed = rows.join(files.select("relative", F.col("ord").alias("file_ord")), "relative")
    ord_ = (F.col("file_ord") * (1 << 20) + F.col("nth")).alias("ord")
    nodes = placed.where("is_node").select("id", "label", "node_type", F.col("relative").alias("file"), "line", F.lit(0).cast("bigint").alias("community"), ord_)
    return nodes, placed.where("not is_node").select("from_id", "to_id", "kind", "conf_class", "conf_score", ord_)
