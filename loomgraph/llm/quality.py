"""Quality scores by a generalised additive model with pairwise interactions."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, slices, type_of

#: Labelled documents, of those with the least hashes, that are learned from.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 150, 60, 0.1, 1.0

FEATURES = [
    "log_words", "upper_share", "symbol_share", "shouts_per_word", "digit_share", "word_length", "distinct_share",
    "repeat_share", "repeated_lines", "stops_per_word", "words_per_line", "bars_per_word", "commas_per_word",
    "short_word_share", "widest_line", "top_byte_share",
]


def features(text: str | None) -> list[float]:
    """Of a whole text; all zero for a null or empty one."""
    text = text or ""
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, chars = max(1, len(words)), max(1, len(text))
    upper, letters = counts[65:91].sum(), counts[65:91].sum() + counts[97:123].sum() + counts[192:].sum()
    symbols = counts[[35, 36, 37, 38, 42, 60, 62, 124]].sum()
    return [
        np.log1p(len(words)),
        upper / max(1, letters),
        symbols / chars,
        (counts[33] + counts[63]) / n,
        counts[48:58].sum() / chars,
        (chars - counts[32] - counts[10]) / n,
        len(set(words)) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        counts[46] / n,
        min(n / max(1, len(lines)), 500),
        counts[124] / n,
        counts[44] / n,
        sum(1 for w in words if len(w) < 3) / n,
        np.log1p(max(map(len, lines), default=0)),
        counts[np.r_[33:48, 58:256]].max() / chars,
    ]


class Model:
    """Lookup tables by bins of features and of pairs of features, and their sum's logit."""

    def __init__(self, cuts: list[np.ndarray], pair_cuts: list[np.ndarray], base: float) -> None:
        self.cuts, self.pair_cuts, self.base = cuts, pair_cuts, base
        self.tables = [np.zeros(len(c) + 1) for c in cuts]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def bins(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(cuts)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for bins, table in zip(self.bins(x, self.cuts), self.tables):
            total += table[bins]
        coarse = self.bins(x, self.pair_cuts) if self.pairs else []
        for (i, j), table in self.pairs.items():
            total += table[coarse[i], coarse[j]]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def _leaf(g, h):
    return g / (h + RIDGE)


def _split(g: np.ndarray, h: np.ndarray) -> int:
    """Where cutting bins in two gains most: the first bin on the right, 0 for no cut."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = left_g**2 / (left_h + RIDGE) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + RIDGE)
    return int(gain.argmax()) + 1 if len(gain) and gain.max() > g.sum() ** 2 / (h.sum() + RIDGE) + 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two over bins, as the step for each bin."""
    out = np.zeros(len(g))
    first = _split(g, h)
    for lo, hi in ((0, first), (first, len(g))) if first else ((0, len(g)),):
        cut = lo + _split(g[lo:hi], h[lo:hi])
        for a, b in ((lo, cut), (cut, hi)) if cut > lo else ((lo, hi),):
            out[a:b] = RATE * _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, step for each pair of bins) of the best cut of both axes."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    best, at = -1.0, (0, 0)
    whole = cg[-1, -1] ** 2 / (ch[-1, -1] + RIDGE)
    r, c = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")
    if r.size:
        parts = [
            (a[r, c], a[r, -1] - a[r, c], a[-1, c] - a[r, c], a[-1, -1] - a[r, -1] - a[-1, c] + a[r, c]) for a in (cg, ch)
        ]
        gain = sum(x**2 / (y + RIDGE) for x, y in zip(*parts)) - whole
        k = int(gain.argmax())
        best, at = float(gain.flat[k]), (int(r.flat[k]), int(c.flat[k]))
    step = np.zeros(g.shape)
    for rows in (slice(0, at[0]), slice(at[0], None)):
        for cols in (slice(0, at[1]), slice(at[1], None)):
            step[rows, cols] = RATE * _leaf(g[rows, cols].sum(), h[rows, cols].sum())
    return best, step


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting: each round gives each feature's table one shallow tree, then the strongest pairs theirs.

    Without a row the score is a half; with one label only it is that label's share.
    """
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    quantiles = lambda n: [np.unique(np.quantile(c, np.linspace(0, 1, n + 1)[1:-1])) for c in x.T] if len(y) else [np.zeros(0)] * x.shape[1]
    model = Model(quantiles(BINS), quantiles(PAIR_BINS), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    bins = model.bins(x, model.cuts)
    for _ in range(ROUNDS):
        for b, table in zip(bins, model.tables):
            g, h = slopes()
            step = _tree(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)))
            table += step
            total += step[b]
    coarse = model.bins(x, model.pair_cuts)
    sizes = [len(c) + 1 for c in model.pair_cuts]

    def grids(i: int, j: int) -> tuple[float, np.ndarray]:
        cell, shape = coarse[i] * sizes[j] + coarse[j], (sizes[i], sizes[j])
        return _quadrants(*(np.bincount(cell, w, sizes[i] * sizes[j]).reshape(shape) for w in slopes()))

    gains = sorted(((grids(i, j)[0], i, j) for i, j in combinations(range(len(sizes)), 2)), reverse=True)
    chosen = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
    model.pairs = {(i, j): np.zeros((sizes[i], sizes[j])) for i, j in chosen}
    for _ in range(PAIR_ROUNDS):
        for i, j in chosen:
            _, step = grids(i, j)
            model.pairs[i, j] += step
            total += step[coarse[i], coarse[j]]
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [features(text) for text in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("quality"), pa.array(found, pa.list_(pa.float64()))], names=["quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, learn) -> Model:
    """Learns from at most SAMPLE rows of labels (doc_id, quality) for which learn holds and quality is 0 or 1.

    Their documents are picked by a broadcast of at most SAMPLE ids; a document
    with several labels counts with its least.
    """
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = hash_sample(known, SAMPLE, "doc_id")
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("quality", "text")
    rows = sample.mapInArrow(_features, "quality int, x array<double>").orderBy("quality", "x").limit(2 * SAMPLE).toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    return train(x, rows["quality"].to_numpy(float))


def _scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        x = np.array([features(text) for text in batch.column("text").to_pylist()], float).reshape(batch.num_rows, len(FEATURES))
        score = model.scores(x)
        yield pa.record_batch([*(c for k, c in zip(batch.schema.names, batch.columns) if k != "text"), pa.array(score)], names=[*(k for k in batch.schema.names if k != "text"), "score"])


def score(docs: DataFrame, model: Model, *keys: str) -> DataFrame:
    """docs (keys, text, ...) -> keys, score (0 to 1, higher: better), one row per row.

    Null and empty texts have all features zero and are scored like any other;
    other columns are not read.
    """
    schema = ", ".join(f"{k} {type_of(docs, k)}" for k in keys) + ", score double"
    return docs.select(*keys, "text").mapInArrow(partial(_scores, model=model), schema)


def _passing(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        x = np.array([features(text) for text in batch.column("text").to_pylist()], float).reshape(batch.num_rows, len(FEATURES))
        yield batch.filter(pa.array(model.scores(x) >= 0.5))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, whose score is a half or more."""
    return docs.mapInArrow(partial(_passing, model=model), docs.schema)
