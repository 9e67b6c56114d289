"""Approximate nearest neighbours along shifted Hilbert curves of projected vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save, type_of

#: Orderings, each of another random projection and shift.
CURVES = 8
#: Axes and bits of each that a curve's key is made of.
AXES, BITS = 8, 7
#: Neighbouring vectors on a curve that meet; a query sees its own block and those beside it.
BLOCK = 4096
#: Blocks of a curve at most. Larger tables have larger blocks, as recall goes by the share that a query sees.
BLOCKS = 20
SEED = 20
#: Vectors beyond those wanted whose scores are summed exactly, as rounding may have put them behind.
SPARE = 8


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of cell numbers (unsigned, below 2**bits).

    Takes the bits of all axes from the highest, undoing the curve's reflections
    and exchanges at each, and then decodes the Gray code of what is left.
    """
    x = cells.astype(np.uint64).T.copy()
    axes, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        low = (one << np.uint64(b)) - one
        for i in range(axes):
            high = (x[i] >> np.uint64(b)) & one == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low).astype(np.uint64)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(b)) & one == 1, (one << np.uint64(b)) - one, 0).astype(np.uint64)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


_erf = np.vectorize(math.erf, otypes=[float])


class Curves:
    """Keys of vectors on every curve.

    Largest inner products are nearest neighbours once a further axis brings all
    vectors to the greatest length; queries, which have nothing on that axis, are
    scaled to it.
    """

    def __init__(self, width: int, longest: float, mean: np.ndarray, deviation: float) -> None:
        random = np.random.default_rng(SEED)
        self.longest, self.mean, self.deviation = longest, mean, max(deviation, 1e-12)
        axes = min(AXES, width + 1)
        self.turns = [np.linalg.qr(random.normal(size=(width + 1, axes)))[0] for _ in range(CURVES)]
        self.shifts = random.uniform(0, 0.5, size=(CURVES, axes))

    def keys(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(vectors, curves)"""
        length = np.linalg.norm(x, axis=1, keepdims=True)
        if query:
            whole = np.hstack([x * (self.longest / np.maximum(length, 1e-300)), np.zeros_like(length)])
        else:
            whole = np.hstack([x, np.sqrt(np.maximum(self.longest**2 - length**2, 0))])
        whole -= self.mean
        found = []
        for turn, shift in zip(self.turns, self.shifts):
            share = (1 + _erf(whole @ turn / (self.deviation * math.sqrt(2)))) / 2
            cells = np.minimum((share + shift) / 1.5 * (1 << BITS), (1 << BITS) - 1)
            found.append(hilbert(cells.astype(np.uint64), BITS))
        return np.stack(found, axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _keyed(batches: Iterator[pa.RecordBatch], curves: Curves) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column("vector"))
        for query in (False, True):
            rows = np.flatnonzero(batch.column("asks").to_numpy(zero_copy_only=False)) if query else np.arange(len(x))
            keys = curves.keys(x[rows], query)
            for c in range(CURVES):
                picked = batch.take(pa.array(rows))
                yield pa.record_batch([pa.array(np.full(len(rows), c, np.int32)), pa.array(keys[:, c]), pa.array(np.full(len(rows), query)), picked.column("rep"), picked.column("vector")], names=["curve", "key", "query", "rep", "vector"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each row in its partition and curve, counting vectors alone."""
    task, seen = TaskContext.get().partitionId(), np.zeros(CURVES, np.int64)
    for batch in batches:
        curve = batch.column("curve").to_numpy(zero_copy_only=False)
        data = ~batch.column("query").to_numpy(zero_copy_only=False)
        place = np.zeros(len(curve), np.int64)
        for c in np.unique(curve):
            mine = curve == c
            place[mine] = seen[c] + np.cumsum(data[mine]) - data[mine]
            seen[c] += data[mine].sum()
        yield pa.record_batch([*batch.columns, pa.array(np.full(len(curve), task, np.int32)), pa.array(place)], names=[*batch.schema.names, "task", "place"])


def _scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last, so that a pair has one score wherever it meets."""
    return np.add.accumulate(x * y, axis=1)[:, -1]


def _nearest(table: pa.Table, k: int) -> pa.Table:
    """The best k vectors of a block for each of its queries.

    A matrix product, whose rounding depends on its shape, picks SPARE more than
    k, and all that are as near as the last of them.
    """
    asks = table.column("query").combine_chunks().to_numpy(zero_copy_only=False)
    rep = table.column("rep").combine_chunks().to_numpy(zero_copy_only=False)
    x = _matrix(table.column("vector").combine_chunks()) if len(table) else np.zeros((0, 1))
    ids, queries = rep[~asks], np.flatnonzero(asks)
    order = np.argsort(ids, kind="stable")
    ids, data = ids[order], x[~asks][order]
    asked, found, scores = [], [], []
    for at in range(0, len(queries) if len(ids) else 0, 512):
        part = queries[at : at + 512]
        s = x[part] @ data.T
        most = min(k + SPARE, s.shape[1])
        edge = np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most]
        for row, (line, least) in enumerate(zip(s, edge)):
            hit = np.flatnonzero(line >= least)
            score = _scores(x[part[row]][None, :], data[hit])
            # ids ascend, so a stable sort keeps the least of those that tie
            order = np.argsort(-score, kind="stable")[:k]
            asked.append(np.full(len(order), rep[part[row]]))
            found.append(ids[hit[order]])
            scores.append(score[order])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return pa.table({"asked": join(asked, np.int64), "found": join(found, np.int64), "score": join(scores, np.float64)})


def block_size(n: int) -> int:
    """Vectors in a block of n."""
    return max(BLOCK, -(-n // BLOCKS))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) without null, zero and non-finite vectors, and of the commonest length, as vector."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = vectors.select("vec_id", x.alias("vector")).where(
        F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(x, lambda v: v != 0)
    )
    return good


def search(vectors: DataFrame, asks: Column, k: int = 20) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> query_id, rank, vec_id, score for each row that asks.

    score is the inner product in double precision, summed from the first
    component to the last; nearest first, ties to the
    smaller vec_id; a row is no candidate of its own query. Rows alike in id and
    vector count once. Equal vectors are indexed once, with the k + 1 least ids,
    of which no query can want more, so a vector that many rows share costs one.

    Every vector is put on CURVES Hilbert curves, range-partitioned by its key, and
    numbered along each; queries meet the vectors of their block and of both
    neighbours, and the best of all curves are merged by exact scores. Blocks
    have BLOCK vectors, or a BLOCKS-th of all if that is more, so that a query sees
    the same share of a curve, and finds as much, in a table of any size; work then
    grows with rows times queries. Up to three blocks the search is exact. Null,
    zero and non-finite vectors and those of another length than the most common
    one take no part; an empty table gives an empty result.
    """
    kind = type_of(vectors, "vec_id")
    good = usable(vectors)
    width = good.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    good = save(good.where(F.size("vector") == width.w).withColumn("asks", asks).distinct(), "vectors")
    same = Window.partitionBy("vector").orderBy("vec_id")
    ids = good.select("vec_id", "vector").withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1)
    distinct = ids.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asking = good.groupBy("vector").agg(F.max("asks").alias("asks"))
    distinct = save(distinct.join(asking, "vector"), "distinct")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v))
    facts = distinct.agg(F.count("*").alias("n"), F.max(length).alias("longest"), F.avg(length * length).alias("square"), *(F.avg(F.col("vector")[i]).alias(f"m{i}") for i in range(width.w))).first()
    mean = np.array([facts[f"m{i}"] for i in range(width.w)] + [0.0])
    deviation = math.sqrt(max(facts.square - float(mean @ mean), 0) / width.w)
    curves = Curves(width.w, facts.longest, mean, deviation)
    keyed = distinct.select("rep", "vector", "asks").mapInArrow(partial(_keyed, curves=curves), f"curve int, key bigint, query boolean, rep {kind}, vector array<double>")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, "curve", "key", "rep").sortWithinPartitions("curve", "key", "rep", "query")
    numbered = save(ordered.mapInArrow(_numbered, f"curve int, key bigint, query boolean, rep {kind}, vector array<double>, task int, place bigint"), "numbered")
    counts = numbered.groupBy("task", "curve").agg(F.count_if(~F.col("query")).alias("n"))
    earlier = Window.partitionBy("curve").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each partition and curve
    starts = counts.select("task", "curve", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    numbered = numbered.join(F.broadcast(starts), ["task", "curve"])
    block = F.floor((F.col("place") + F.col("start")) / block_size(facts.n))
    spread = F.when(F.col("query"), F.array(block - 1, block, block + 1)).otherwise(F.array(block))
    blocks = numbered.select("curve", "query", "rep", "vector", F.explode(spread).alias("block"))
    found = blocks.groupBy("curve", "block").applyInArrow(lambda table: _nearest(table, k + 1), "asked bigint, found bigint, score double")
    once = found.groupBy("asked", "found").agg(F.max("score").alias("score"))
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "found")
    merged = once.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    members = distinct.select(F.col("rep").alias("found"), F.explode("ids").alias("vec_id"))
    per_vector = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    answers = merged.select("asked", "found", "score").join(members, "found").withColumn("nth", F.row_number().over(per_vector)).where(F.col("nth") <= k + 1)
    queries = good.where("asks").select(F.col("vec_id").alias("query_id"), "vector").join(distinct.select("vector", F.col("rep").alias("asked")), "vector").select("query_id", "asked")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        queries.join(answers.select("asked", "vec_id", "score"), "asked")
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("vec_id").cast(kind).alias("vec_id"), "score")
    )


#: What search() returns for every 20th vector of a view embeddings while it is exact, in SQL.
SQL = """with good as (select vec_id, cast(embedding as double[]) as v from embeddings
 where vec_id is not null and embedding is not null and len(embedding) = len(list_filter(embedding, lambda x: x is not null and isfinite(x))) and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 width as (select len(v) as w from good group by 1 order by count(*) desc, 1 limit 1), held as (select distinct * from good where len(v) = (select w from width)),
 scored as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.v, b.v) as score from held a join held b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
 ranked as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from scored)
select query_id, rank, vec_id, score from ranked where rank <= 20"""
