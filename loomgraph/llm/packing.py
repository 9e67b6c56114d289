"""Packing token sequences by non-negative least squares over length patterns."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, slices, type_of

#: Words whose ids a Python worker remembers in each of two generations.
CACHE_WORDS = 400_000
#: Documents whose words are looked up together.
TOKENIZED = 512
#: Signs that are taken off words, and what a text must not hold for that.
TAKEN_OFF = (".", ",")
RUNS = ("..", ",,", ".,", ",.", "<|")
#: The shortest of three lengths that fill a window together is a multiple of window / this.
TRIPLE_STEPS = 32
ROUNDS = 80


class WordIds:
    """Ids of texts, as little-endian 32-bit numbers, from those of their words.

    The tokenizer never joins characters across white space, so a text's ids are
    those of its words in order, and most words have been seen before. It ignores
    case and parts letters from punctuation, so in most texts full stops and commas
    can be taken off first, which leaves fewer different words. New words are
    encoded together, in one text, and told apart by where their ids begin or end.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: For lower-case Latin letters, on which the normalizer does nothing.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        #: Words by their ids, in two generations.
        self.known, self.older = {}, {}
        #: Known words that end with a sign, with which one taken off behind them would be a single run.
        self.signed = set()
        spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
        apart = self.ids("a") + self.ids("b")
        #: What str.split() parts at, but the tokenizer may not.
        self.odd = [c for c in spaces if self.ids(f"a{c}b") != apart]

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, texts: list[list[str]]) -> None:
        words = list(set().union(*texts).difference(self.known))
        if not words:
            return
        self.signed.update(w for w in words if not w[-1].isalnum() and w not in TAKEN_OFF)
        letters, others = [], []
        for w in words:
            if (found := self.older.get(w)) is not None:
                self.known[w] = found
            elif w.isalpha() and w.islower() and max(w) <= "\xff":
                letters.append(w)
            else:
                others.append(w)
        self.encode_letters(letters)
        self.encode(others)

    def encode(self, words: list[str]) -> None:
        if words:
            done = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
            begins = np.fromiter((a for a, _ in done.offsets), np.int64, len(done.ids))
            self.split(words, np.array(done.ids, "<u4"), np.searchsorted(begins, np.cumsum([0, *(len(w) + 1 for w in words)])))

    def encode_letters(self, words: list[str]) -> None:
        """Of a word of letters only the last id ends a word, if the vocabulary marks ends."""
        if words:
            ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(words) and ends[-1] == len(ids):
                self.split(words, ids, np.concatenate([[0], ends]))
            else:
                self.encode(words)

    def split(self, words: list[str], ids: np.ndarray, cuts: np.ndarray) -> None:
        data, cuts = ids.tobytes(), (4 * cuts).tolist()
        self.known.update((w, data[a:b]) for w, a, b in zip(words, cuts, cuts[1:]))

    def words(self, text: str) -> list[str]:
        """A text's words without the stops and commas at their ends, which are words of their own.

        Only of texts of Latin letters, whose lower case depends on nothing around
        them, without control tokens and without two such signs in a row.
        """
        if any(x in text for x in RUNS):
            return []
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return []
        return f"{text.lower()} ".replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n").split()

    def of_texts(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known, self.older, self.signed = {}, self.known, set()
        odd = [any(c in text for c in self.odd) for text in texts]
        words = [[] if o else self.words(text) for text, o in zip(texts, odd)]
        self.learn(words)
        # signs before a sign that was taken off belong to one run: such texts are taken word by word as they are
        whole = [not o and (not w or not self.signed.isdisjoint(w)) for w, o in zip(words, odd)]
        words = [text.split() if x else w for text, w, x in zip(texts, words, whole)]
        self.learn([w for w, x in zip(words, whole) if x])
        at = self.known.__getitem__
        return [self.ids(text) if o else b"".join(map(at, w)) for text, o, w in zip(texts, odd, words)]


#: Kept from task to task by a Python worker.
_word_ids: dict[str, WordIds] = {}


def _tokenized(batches: Iterator[pa.RecordBatch], path: str, window: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """A document's whole windows by their checksums, its tail with ids, and running counts in this task."""
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    words = _word_ids[path]
    end, size = np.array([end_id], "<u4").tobytes(), 4 * window
    task, row, full = TaskContext.get().partitionId(), 0, 0
    seen: dict[int, int] = defaultdict(int)
    for batch in slices(batches, TOKENIZED):
        out: dict[str, list] = {k: [] for k in ("row", "doc_tokens", "full_rank", "full_crc", "tail", "rank", "tail_crc", "tail_ids")}
        for ids in words.of_texts([text or "" for text in batch.column("text").to_pylist()]):
            ids += end
            n_full = len(ids) // size
            tail = ids[n_full * size :]
            length = len(tail) // 4
            values = (row, len(ids) // 4, full, [zlib.crc32(ids[i * size : (i + 1) * size]) for i in range(n_full)], length, seen[length], zlib.crc32(tail), tail)
            for column, value in zip(out.values(), values):
                column.append(value)
            row, full = row + 1, full + n_full
            seen[length] += 1
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array([task] * batch.num_rows, pa.int32())]
            + [pa.array(v, {"full_crc": pa.list_(pa.int64()), "tail": pa.int32(), "tail_ids": pa.binary()}.get(k, pa.int64())) for k, v in out.items()],
            names=["doc_id", "task", *out],
        )


def patterns(window: int) -> np.ndarray:
    """Shallow combinations of lengths that fill a window: pairs, then triples (rows of three, 0: none)."""
    pairs = [(0, a, window - a) for a in range(1, window // 2 + 1)]
    step = max(1, window // TRIPLE_STEPS)
    triples = [(a, b, window - a - b) for a in range(step, window // 3 + 1, step) for b in range(a, (window - a) // 2 + 1)]
    return np.array(pairs + triples, np.int64)


def solve(histogram: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, repeats): repeats >= 0 minimise |A x - histogram|, rounded so that no length is overdrawn.

    Accelerated projected gradient; a column of A has three entries at most, so a
    step costs as much as there are patterns, whatever the corpus holds.
    """
    combos = patterns(window)
    combos = combos[((histogram[combos] > 0) | (combos == 0)).all(axis=1)]
    if not len(combos):
        return combos, np.zeros(0, np.int64)
    counts = histogram.astype(float)
    counts[0] = 0

    def used(x: np.ndarray) -> np.ndarray:
        total = sum(np.bincount(combos[:, k], x, window + 1) for k in range(3))
        total[0] = 0
        return total

    degree = used(np.ones(len(combos)))
    x = np.min(np.where(combos > 0, counts[combos] / np.maximum(degree[combos], 1), np.inf), axis=1)
    step, y, t = 1 / (3 * max(degree.max(), 1)), x, 1.0
    for _ in range(ROUNDS):
        miss = used(y) - counts
        miss[0] = 0
        new = np.maximum(0, y - step * miss[combos].sum(axis=1))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / t_new * (new - x), t_new
    left = histogram.astype(np.int64).copy()
    repeats = np.zeros(len(combos), np.int64)
    floor, part = np.floor(x).astype(np.int64), x - np.floor(x)
    for want, order in ((floor, np.argsort(-floor, kind="stable")), (np.ceil(part), np.argsort(-part, kind="stable"))):
        for p in order[want[order] > 0]:
            lengths = [k for k in combos[p] if k]
            most = min(left[k] // lengths.count(k) for k in lengths)
            n = min(int(want[p]), int(most))
            if n > 0:
                repeats[p] += n
                for k in lengths:
                    left[k] -= n
    return combos, repeats


class Plan:
    """Which sequence and offset the document of a rank among those with its length gets."""

    def __init__(self, combos: np.ndarray, repeats: np.ndarray, window: int) -> None:
        used = repeats > 0
        combos, repeats = combos[used], repeats[used]
        base = np.cumsum(repeats) - repeats
        self.sequences = int(repeats.sum())
        offsets = np.cumsum(combos, axis=1) - combos
        length, n = combos.ravel(), np.repeat(repeats, 3)
        order = np.lexsort((np.arange(len(length)), length))
        order = order[length[order] > 0]
        self.length, n = length[order], n[order]
        self.first, self.offset = np.repeat(base, 3)[order], offsets.ravel()[order]
        before = np.cumsum(n) - n
        starts = np.searchsorted(self.length, self.length)
        self.start = before - before[starts] if len(n) else before
        self.end = self.start + n
        #: Documents of each length that have a place; the rest is packed greedily.
        self.placed = np.bincount(self.length, n, window + 1).astype(np.int64)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence or -1, offset) for each length and rank."""
        if not len(self.length):
            return np.full(len(length), -1), np.zeros(len(length), np.int64)
        most = 1 << 40
        at = np.searchsorted(self.length * most + self.start, length * most + rank, side="right") - 1
        at = np.maximum(at, 0)
        hit = (self.length[at] == length) & (rank >= self.start[at]) & (rank < self.end[at])
        return np.where(hit, self.first[at] + rank - self.start[at], -1), np.where(hit, self.offset[at], 0)


PIECE = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _place(batches: Iterator[pa.RecordBatch], plan: Plan, window: int, full_base: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Pieces of documents; tails without a place keep their ids and get no sequence."""
    for batch in batches:
        col = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("task", "row", "doc_tokens", "full_rank", "tail", "tail_crc", "rank")}
        crcs = batch.column("full_crc")
        n_full = col["doc_tokens"] // window
        first = np.array([full_base[t] for t in col["task"].tolist()], np.int64) + col["full_rank"]
        doc = np.repeat(np.arange(batch.num_rows), n_full)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_full) - n_full, n_full)
        sequence, offset = plan.place(col["tail"].astype(np.int64), col["rank"])
        tails = np.flatnonzero(col["tail"] > 0)
        rows = np.concatenate([doc, tails])
        out = {
            "start": np.concatenate([nth * window, (n_full * window)[tails]]),
            "length": np.concatenate([np.full(len(doc), window), col["tail"][tails].astype(np.int64)]),
            "ids_crc32": np.concatenate([crcs.flatten().to_numpy(zero_copy_only=False).astype(np.int64), col["tail_crc"][tails]]),
            "doc_tokens": col["doc_tokens"][rows],
            "sequence_id": np.concatenate([first[doc] + nth, sequence[tails]]),
            "offset": np.concatenate([np.zeros(len(doc), np.int64), offset[tails]]),
            "task": col["task"][rows].astype(np.int32),
            "row": col["row"][rows],
        }
        ids = batch.column("tail_ids")
        loose = pa.array(out["sequence_id"] < 0)
        kept = pa.compute.if_else(loose, ids.take(pa.array(rows)), pa.scalar(None, pa.binary()))
        yield pa.record_batch([batch.column("doc_id").take(pa.array(rows)), *map(pa.array, out.values()), kept], names=["doc_id", *out, "ids"])


def _cut(batches: Iterator[pa.RecordBatch], base: dict[int, int], total: int, window: int, first: int) -> Iterator[pa.RecordBatch]:
    """Loose tails laid end to end and cut where a window ends; what is left of the last is cut at powers of two."""
    whole = total // window
    edges, rest = [whole * window], total % window
    while rest:
        edges.append(edges[-1] + (1 << rest.bit_length() - 1))
        rest -= 1 << rest.bit_length() - 1
    for batch in slices(batches):
        rows: list[tuple] = []
        for i, (task, before, start, ids, tokens) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("task", "before", "start", "ids", "doc_tokens")))):
            at, end = base[task] + before, base[task] + before + len(ids) // 4
            begin = at
            while at < end:
                if at < edges[0]:
                    sequence, left = at // window, at // window * window
                    right = left + window
                else:
                    k = int(np.searchsorted(edges, at, side="right")) - 1
                    sequence, left, right = whole + k, edges[k], edges[k + 1]
                to = min(end, right)
                rows.append((i, start + at - begin, to - at, zlib.crc32(ids[4 * (at - begin) : 4 * (to - begin)]), tokens, first + sequence, at - left))
                at = to
        index, *columns = zip(*rows) if rows else ([],) * 7
        yield pa.record_batch([batch.column("doc_id").take(pa.array(index, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *PIECE])


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """docs (doc_id, text, ...) -> pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and end_id (null and empty texts: end_id alone).
    Whole windows of a document are sequences of their own. The rests are counted
    by length; patterns of two or three lengths that fill a window are solved for
    by non-negative least squares against that histogram and rounded; documents
    take places by their rank among those of their length. What finds no place is
    laid end to end, in order, and cut at window ends, and the last, unfilled
    window at powers of two, so that nothing is padded.

    The driver gets the histogram (one row per length below the window) and one
    row per input partition. Ranks come from running counts in each input
    partition, so no length, however common, meets in one task. Repeated rows are
    packed as often as they come; doc_id may be null; other columns are not read;
    an empty table gives no piece.
    """
    kind = type_of(docs, "doc_id")
    tokens = save(
        docs.select("doc_id", "text").mapInArrow(
            partial(_tokenized, path=tokenizer, window=window, end_id=end_id),
            f"doc_id {kind}, task int, row bigint, doc_tokens bigint, full_rank bigint, full_crc array<bigint>, tail int, rank bigint, tail_crc bigint, tail_ids binary",
        ),
        "tokens",
    )
    counts = save(tokens.groupBy("task", "tail").agg(F.count("*").alias("n"), F.sum(F.size("full_crc")).alias("n_full")), "counts")
    histogram = np.zeros(window + 1, np.int64)
    for tail, n in counts.groupBy("tail").agg(F.sum("n")).collect():
        histogram[tail] = n
    histogram[0] = 0
    plan = Plan(*solve(histogram, window), window)
    loose = int(((histogram - plan.placed) * np.arange(window + 1)).sum())
    after = plan.sequences + loose // window + window.bit_length()

    full_base, at = {}, after
    for task, n in sorted(counts.groupBy("task").agg(F.sum("n_full")).collect()):
        full_base[task], at = at, at + n
    earlier = Window.partitionBy("tail").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("task", "tail", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    short = [int(k) for k in np.flatnonzero(histogram > plan.placed)]  # lengths of which some find no place
    ids = F.when(F.element_at(F.lit([k in set(short) for k in range(window + 1)]), F.col("tail") + 1), F.col("tail_ids"))
    placed = save(
        tokens.withColumn("tail_ids", ids)
        .join(ranks, ["task", "tail"])
        .select("doc_id", "task", "row", "doc_tokens", "full_rank", "full_crc", "tail", (F.col("rank") + F.col("before")).alias("rank"), "tail_crc", "tail_ids")
        .mapInArrow(
            partial(_place, plan=plan, window=window, full_base=full_base),
            f"doc_id {kind}, " + ", ".join(f"{k} bigint" for k in PIECE) + ", task int, row bigint, ids binary",
        ),
        "placed",
    )
    rest = placed.where("sequence_id < 0")
    base, at = {}, 0
    for task, n in sorted(rest.groupBy("task").agg(F.sum("length")).collect()):
        base[task], at = at, at + n
    running = Window.partitionBy("task").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    cut = rest.select("doc_id", "task", "start", "ids", "doc_tokens", F.coalesce(F.sum("length").over(running), F.lit(0)).alias("before")).mapInArrow(
        partial(_cut, base=base, total=at, window=window, first=plan.sequences),
        f"doc_id {kind}, " + ", ".join(f"{k} bigint" for k in PIECE),
    )
    return placed.where("sequence_id >= 0").select("doc_id", *PIECE).unionByName(cut)
