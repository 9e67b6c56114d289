"""Language identification by unigram pieces, summed over every segmentation."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, slices, type_of

#: Documents of each language, of those with the least hashes, that are learned from.
SAMPLE_PER_LANGUAGE = 400
ROUNDS = 4
#: Count that every piece has in every language.
PRIOR = 0.01
CACHE_WORDS = 200_000
#: Characters of words whose lattices are held at a time.
LATTICE_CHARS = 1 << 16
#: A word is a run of letters.
_letters = re.compile(r"[^\W\d_]+")
WORD_START = "▁"
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: High bits of a hash that a table of what pieces have goes by.
_SEEN_BITS = 21


def words_of(text: str) -> list[str]:
    return _letters.findall(text.lower())


class Pieces:
    """The fixed pieces of a public model, without its control and byte pieces, found by the rolling hashes of substrings."""

    def __init__(self, pieces: list[str]) -> None:
        self.pieces = list(dict.fromkeys(pieces))
        self.longest = max(map(len, self.pieces), default=1)
        hashes = np.zeros(len(self.pieces), np.uint64)
        for i, piece in enumerate(self.pieces):
            for c in _codes(piece)[:, None]:
                hashes[i : i + 1] = _roll(hashes[i : i + 1], c)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.seen = np.zeros(1 << _SEEN_BITS, bool)
        self.seen[self.hashes >> np.uint64(64 - _SEEN_BITS)] = True

    def __len__(self) -> int:
        return len(self.pieces)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes that are pieces', and these pieces' numbers."""
        at = np.flatnonzero(self.seen[hashes >> np.uint64(64 - _SEEN_BITS)])
        if not len(at) or not len(self.hashes):
            return at[:0], at[:0]
        spot = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        hit = self.hashes[spot] == hashes[at]
        return at[hit], self.order[spot[hit]]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _roll(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    h = (hashes ^ (codes + np.uint64(1)) * _SPREAD) * _BASE
    return h ^ h >> np.uint64(29)


def vocabulary(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Pieces([model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))])


class Lattices:
    """Every way to cut words into pieces, as edges between positions.

    A character that is no piece is an edge with the index len(pieces), so each
    position is reached and each word has a segmentation. Probabilities are kept as
    logs, so words may be of any length.
    """

    def __init__(self, words: list[str], pieces: Pieces) -> None:
        self.lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        codes = _codes(WORD_START + WORD_START.join(words))
        owner = np.repeat(np.arange(len(words)), self.lengths)
        first = np.cumsum(self.lengths) - self.lengths
        start = np.arange(len(codes)) - first[owner]
        rest = self.lengths[owner] - start
        hashes, here = np.zeros(len(codes), np.uint64), np.arange(len(codes))
        found = []
        for size in range(1, min(pieces.longest, int(self.lengths.max(initial=0))) + 1):
            if size > 1:
                inside = rest[here] >= size
                here, hashes = here[inside], hashes[inside]
            hashes = _roll(hashes, codes[here + size - 1])
            at, piece = pieces.find(hashes)
            if size == 1:
                numbers = np.full(len(codes), len(pieces), np.int64)
                numbers[at] = piece
                at, piece = here, numbers
            spots = here[at]
            found.append(np.stack([start[spots] + size, owner[spots], start[spots], piece]))
        edges = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
        self.end, self.word, self.start, self.piece = edges[:, np.lexsort((edges[1], edges[0]))]

    def _summed(self, logs: np.ndarray, heads: np.ndarray, count: np.ndarray) -> np.ndarray:
        most = np.maximum.reduceat(logs, heads, axis=0)
        return most + np.log(np.add.reduceat(np.exp(logs - np.repeat(most, count, axis=0)), heads, axis=0))

    def forward(self, log_p: np.ndarray) -> np.ndarray:
        """log_p (pieces, languages) -> the log mass of all segmentations up to each position."""
        alpha = np.zeros((len(self.lengths), self.lengths.max(initial=0) + 1, log_p.shape[1]))
        weight = log_p[self.piece]
        for end, at, to in self._steps(self.end):
            word, mass = self.word[at:to], alpha[self.word[at:to], self.start[at:to]] + weight[at:to]
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            alpha[word[heads], end] = self._summed(mass, heads, np.diff(np.r_[heads, len(word)]))
        return alpha

    def logs(self, log_p: np.ndarray) -> np.ndarray:
        """(words, languages): the log of the probability of each word."""
        return self.forward(log_p)[np.arange(len(self.lengths)), self.lengths]

    def expected(self, log_p: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """How often each piece is used, by language, over all segmentations of the weighted words."""
        alpha, weight = self.forward(log_p), log_p[self.piece]
        beta = np.zeros_like(alpha)
        order = np.lexsort((self.word, -self.start))
        # as forward(), from the last start to the first
        for start, at, to in self._steps(self.start[order]):
            part = order[at:to]
            word, mass = self.word[part], beta[self.word[part], self.end[part]] + weight[part]
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            beta[word[heads], start] = self._summed(mass, heads, np.diff(np.r_[heads, len(word)]))
        whole = alpha[np.arange(len(self.lengths)), self.lengths]
        used = np.exp(alpha[self.word, self.start] + weight + beta[self.word, self.end] - whole[self.word]) * weights[self.word]
        return np.stack([np.bincount(self.piece, used[:, k], len(log_p)) for k in range(log_p.shape[1])], axis=1)

    @staticmethod
    def _steps(ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
        cuts = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]]) if len(ends) else []
        for at, to in zip(cuts, [*cuts[1:], len(ends)]):
            yield int(ends[at]), int(at), int(to)


def parts(words: list[str]) -> Iterator[np.ndarray]:
    """Numbers of words in parts of LATTICE_CHARS characters or one word, alike in length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    order = np.argsort(sizes, kind="stable")
    begin = 0
    while begin < len(order):
        # a part takes as many places as its longest word has, for each of its words
        cost = sizes[order[begin:]] * np.arange(1, len(order) - begin + 1)
        end = begin + max(1, int(np.searchsorted(cost, LATTICE_CHARS, side="right")))
        yield order[begin:end]
        begin = end


class Model:
    """Log probabilities of pieces by language."""

    def __init__(self, languages: list[str], pieces: Pieces, p: np.ndarray) -> None:
        self.languages, self.pieces, self.log_p = languages, pieces, np.log(p)

    def logs(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        for part in parts(words):
            out[part] = Lattices([words[i] for i in part], self.pieces).logs(self.log_p)
        return out

    def expected(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.log_p.shape)
        for part in parts(words):
            out += Lattices([words[i] for i in part], self.pieces).expected(self.log_p, weights[part])
        return out

    def learned(self, used: np.ndarray) -> Model:
        used = used + PRIOR
        return Model(self.languages, self.pieces, used / used.sum(axis=0))


def uniform(languages: list[str], pieces: Pieces) -> Model:
    return Model(languages, pieces, np.full((len(pieces) + 1, len(languages)), 1 / (len(pieces) + 1)))


def _expected(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Batches of (lang, word, n) -> (lang, piece, used), summed over a task."""
    number = {lang: i for i, lang in enumerate(model.languages)}
    total = np.zeros(model.log_p.shape)
    for batch in batches:
        rows = [number[lang] for lang in batch.column("lang").to_pylist()]
        weights = np.zeros((batch.num_rows, len(number)))
        weights[np.arange(batch.num_rows), rows] = batch.column("n").to_numpy()
        total += model.expected(batch.column("word").to_pylist(), weights)
    piece, lang = np.nonzero(total)
    yield pa.record_batch([pa.array(lang.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[piece, lang])], names=["lang", "piece", "used"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            found.update((lang, word) for word in words_of(text))
        yield pa.record_batch([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])


def fit(docs: DataFrame, learn, vocabulary_path: str) -> Model:
    """Learns from rows of docs (doc_id, text, lang) for which learn holds and lang isn't null.

    The sample is bounded: SAMPLE_PER_LANGUAGE documents of a language, by the hash
    of their id; all words of those count. Each round of expectation and
    maximisation sums the pieces' uses in Spark; the driver gets a number for each
    piece and language, whatever the sample holds.
    """
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.select("doc_id", "lang").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= SAMPLE_PER_LANGUAGE).select("doc_id").distinct()
    sample = known.join(F.broadcast(ids), "doc_id").select("lang", "text")
    counts = sample.mapInArrow(_word_counts, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = save(counts.repartition(parts), "words")
    languages = sorted(r.lang for r in counts.select("lang").distinct().collect())
    model = uniform(languages, vocabulary(vocabulary_path))
    for _ in range(ROUNDS if languages else 0):
        sums = counts.mapInArrow(partial(_expected, model=model), "lang int, piece int, used double").groupBy("lang", "piece").agg(F.sum("used").alias("used")).toPandas()
        used = np.zeros(model.log_p.shape)
        used[sums["piece"].to_numpy(), sums["lang"].to_numpy()] = sums["used"].to_numpy()
        model = model.learned(used)
    return model


class _Words:
    """Logs of the words that a Python worker has met."""

    def __init__(self, model: Model) -> None:
        self.model, self.at = model, {}
        self.logs = np.zeros((0, len(model.languages)))

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.at) > CACHE_WORDS:
            self.at, self.logs = {}, self.logs[:0]
        new = list(dict.fromkeys(w for words in texts for w in words if w not in self.at))
        if new:
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            self.logs = np.concatenate([self.logs, self.model.logs(new)])
        return np.stack([self.logs[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(axis=0) for words in texts])


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    known = _Words(model)
    for batch in slices(batches):
        texts = [words_of(text or "") for text in batch.column("text").to_pylist()]
        texts = [words if any(c.isalpha() for w in words for c in w) else [] for words in texts]
        if model.languages:
            logs = known.scores(texts)
            odds = np.exp(logs - logs.max(axis=1, keepdims=True))
            odds /= odds.sum(axis=1, keepdims=True)
            best = odds.argmax(axis=1)
            found = [(model.languages[k], float(o[k])) if words else ("und", 0.0) for words, k, o in zip(texts, best, odds)]
        else:
            found = [("und", 0.0)] * len(texts)
        yield pa.record_batch([*(c for k, c in zip(batch.schema.names, batch.columns) if k != "text"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*(k for k in batch.schema.names if k != "text"), "lang_pred", "score"])


def identify(docs: DataFrame, model: Model, *keys: str) -> DataFrame:
    """docs (keys, text, ...) -> keys, lang_pred, score, one row per row.

    score is the probability of lang_pred among the learned languages, all equally
    likely before. Texts without a letter, null ones and, if nothing could be
    learned, all texts are `und` with score 0. Whole texts are scored; ties go to
    the language that sorts first; other columns are not read.
    """
    schema = ", ".join(f"{k} {type_of(docs, k)}" for k in keys) + ", lang_pred string, score double"
    return docs.select(*keys, "text").mapInArrow(partial(_predict, model=model), schema)
