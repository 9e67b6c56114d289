"""Quality rules, and a log-likelihood ratio of hashed n-grams against the corpus."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.join import shuffled
from .common import save, slices, type_of

WINDOW = 8
#: Buckets that words and pairs of words are hashed to (the raw counts are of all documents).
BUCKETS = 1 << 14
SMOOTHING = 0.5
#: Steps in a ratio of one, by which the driver looks for a quantile.
STEPS = 4096
#: A document is kept at the ratio, per n-gram, of this low quantile of the trusted ones, less the slack.
QUANTILE, SLACK = 0.005, 0.02
CACHE_WORDS = 300_000
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = xxhash.xxh64_intdigest(word)
        if len(word) < 64:
            self[word] = found
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def repeated_words(words: list[bytes], hashes: np.ndarray) -> int:
    """Words that lie in a window of WINDOW words which the text holds twice or more.

    Windows with a hash of their own are new; the few others are compared in full.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    rolled = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        rolled = rolled * _ODD[0] + hashes[k : k + n]
    ordered = np.sort(rolled)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(rolled, twice)).tolist()
    windows = [tuple(words[i : i + WINDOW]) for i in starts]
    seen = Counter(windows)
    edges = np.zeros(len(words) + 1, np.int64)
    for i, window in zip(starts, windows):
        if seen[window] > 1:
            edges[i] += 1
            edges[i + WINDOW] -= 1
    return int((np.cumsum(edges) > 0).sum())


def repeated_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def grams(hashes: np.ndarray) -> np.ndarray:
    """Buckets of a text's words and of its neighbouring pairs."""
    pairs = (hashes[:-1] * _ODD[1] + hashes[1:]) * _ODD[2]
    return (np.concatenate([hashes * _ODD[0], pairs]) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket and input partition."""
    known, raw, trusted = WordHashes(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in slices(batches):
        for text, good in zip(batch.column("text").to_pylist(), batch.column("good").to_pylist()):
            found = np.bincount(grams(known.of(_words(text))), minlength=BUCKETS)
            raw += found
            if good:
                trusted += found
    at = np.flatnonzero(raw)
    yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(trusted[at])], names=["bucket", "raw", "trusted"])


def _per_gram(hashes: np.ndarray, ratio: np.ndarray) -> float:
    at = grams(hashes)
    return float(ratio[at].mean()) if len(at) else 0.0


def _ratios(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in slices(batches):
        found = [_per_gram(known.of(_words(text)), ratio) for text in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "llr"])


def quantile(values: DataFrame, share: float) -> float:
    """The exact quantile of llr, interpolated: the driver gets the counts of steps, then the values of those around it."""
    step = F.floor(F.col("llr") * STEPS)
    counts = sorted(tuple(r) for r in values.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect())
    at = share * (sum(n for _, n in counts) - 1)
    before, low, high = 0, None, None
    for name, n in counts:
        if low is None and before + n > math.floor(at):
            low, skipped = name, before
        if before + n > math.ceil(at):
            high = name
            break
        before += n
    near = sorted(tuple(r) for r in values.where(step.between(low, high)).groupBy("llr").agg(F.count("*").alias("n")).collect())
    ends = np.cumsum([n for _, n in near]) + skipped
    x, y = (near[int(np.searchsorted(ends, k, side="right"))][0] for k in (math.floor(at), math.ceil(at)))
    return x + (y - x) * (at - math.floor(at))


class Model:
    """ratio: log of target over raw probability, by bucket; least: the ratio per n-gram that a kept document has."""

    def __init__(self, ratio: np.ndarray, least: float) -> None:
        self.ratio, self.least = ratio, least


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The raw multinomial is counted on all of docs, the target on labelled good ones among them.

    labels (doc_id, quality) names the trusted documents with quality 1, which are
    all taken. Without any, no ratio rejects a document.
    """
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    good = shuffled(good.withColumn("good", F.lit(True)))
    marked = docs.select("doc_id", "text").join(good, "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    counts = marked.mapInArrow(_counts, "bucket int, raw bigint, trusted bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
    raw, trusted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, t in counts.collect():
        raw[bucket], trusted[bucket] = r, t
    if not trusted.sum():
        return Model(np.zeros(BUCKETS), 0.0)
    smooth = lambda n: (n + SMOOTHING) / (n + SMOOTHING).sum()
    ratio = np.log(smooth(trusted)) - np.log(smooth(raw))
    # all documents are scored, so that ids and ratios meet the trusted ids and not the texts
    llr = docs.select("doc_id", "text").mapInArrow(partial(_ratios, ratio=ratio), f"doc_id {type_of(docs, 'doc_id')}, llr double")
    return Model(ratio, quantile(save(llr.join(good, "doc_id").select("llr"), "ratios"), QUANTILE) - SLACK)


RESULT = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean", "llr": "double"}


def _judge(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in slices(batches):
        rows = []
        for text in batch.column("text").to_pylist():
            text = text or ""
            words = _words(text)
            hashes = known.of(words)
            n, again = len(words), repeated_words(words, hashes)
            failed = n < 20 or 100 * again > 30 * n
            llr = _per_gram(hashes, model.ratio)
            rows.append((n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), repeated_lines(text), again, failed, not failed and llr >= model.least, llr))
        kinds = [pa.bool_() if k == "boolean" else pa.float64() if k == "double" else pa.int64() for k in RESULT.values()]
        columns = zip(*rows) if rows else [()] * len(RESULT)
        yield pa.record_batch([*(c for k, c in zip(batch.schema.names, batch.columns) if k != "text"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*(k for k in batch.schema.names if k != "text"), *RESULT])


def judge(docs: DataFrame, model: Model, *keys: str) -> DataFrame:
    """docs (keys, text, ...) -> keys, counts, base_failed, kept and llr, one row per row.

    kept is false if the counts fail, else whether the mean log ratio of the whole
    text's n-grams reaches the model's threshold. A null text has no words (and so
    fails); repeated rows are judged alike; other columns are not read.
    """
    schema = ", ".join([*(f"{k} {type_of(docs, k)}" for k in keys), *(f"{k} {v}" for k, v in RESULT.items())])
    return docs.select(*keys, "text").mapInArrow(partial(_judge, model=model), schema)
