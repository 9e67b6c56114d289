"""Communities by the Louvain method."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import save
from .components import connected_components

#: Components of more nodes, or more links, are clustered by rounds of joins, not in one task; that many take some 500 MB.
LOCAL_NODES, LOCAL_LINKS = 400_000, 4_000_000
#: Graphs of up to so many nodes have these numbered, and the driver and each task hold two numbers for each (12 bytes); their
#: links are in blocks of about BLOCK ends, of which one in each of TURNS moves at a time; of a block's nodes one in SLICES choose together.
NUMBERED, BLOCK, SLICES, TURNS = 1 << 24, 500_000, 64, (4, 16)
#: In a round of the distributed form a node in so many moves; more, once no round of that size gains anything.
SHARES = (2, 4, 8, 16)


def optimise(start: np.ndarray, to: np.ndarray, weight: np.ndarray, loops: list[float], degree: list[float], m: float) -> list[int]:
    """Communities of nodes 0 to n - 1, moved one by one until none gains.

    Node i's links to others are those from start[i] up to start[i + 1] of to and
    weight, loops has the weights of those to itself. A node goes where the gain is
    strictly above that of staying, ties to the smallest community.
    """
    n, bounds, whole = len(degree), start.tolist(), 2 * m * m
    at, total = list(range(n)), list(degree)
    moved = True
    while moved:
        moved = False
        for i in range(n):
            low, high, d, old = bounds[i], bounds[i + 1], degree[i], at[i]
            near: dict[int, float] = {}
            for j, w in zip(to[low:high].tolist(), weight[low:high].tolist()):
                c = at[j]
                near[c] = near.get(c, 0.0) + w
            total[old] -= d
            best, best_gain = old, (near.pop(old, 0.0) + loops[i]) / m - total[old] * d / whole
            for c in sorted(near) if len(near) > 1 else near:
                if (g := near[c] / m - total[c] * d / whole) > best_gain + 1e-15:
                    best, best_gain = c, g
            total[best] += d
            if best != old:
                at[i], moved = best, True
    return at


def _clustered(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, m: float) -> np.ndarray:
    """Communities of nodes 0 to n - 1, numbered by their first node, after one optimisation."""
    loop, apart = a == b, a != b
    loops = np.bincount(a[loop], w[loop], n)
    degree = np.bincount(a, w, n) + np.bincount(b, w, n)
    a, b, w = a[apart].astype(np.int32), b[apart].astype(np.int32), w[apart]
    order = np.argsort(np.r_[a, b], kind="stable").astype(np.int32)
    start = np.r_[0, np.cumsum(np.bincount(a, minlength=n) + np.bincount(b, minlength=n))]
    to, weight = np.r_[b, a][order], np.r_[w, w][order]
    del a, b, w, order
    return np.array(_numbered(optimise(start, to, weight, loops.tolist(), degree.tolist(), m)), np.int64)


def louvain_weighted(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, m: float) -> list[int]:
    """Communities of nodes 0 to n - 1 of one graph, numbered by their first node.

    Each link (a, b) comes once, in either direction, with the number w of its edges.
    Nodes are optimised, then, once, the communities themselves. m: edges of the
    whole graph, of which this may be one component.
    """
    first = _clustered(n, a, b, w, m)
    k = int(first.max(initial=-1)) + 1
    if k <= 1:
        return first.tolist()
    x, y = np.minimum(first[a], first[b]), np.maximum(first[a], first[b])
    pairs, which = np.unique(x * k + y, return_inverse=True)
    second = _clustered(k, pairs // k, pairs % k, np.bincount(which, w), m)
    return _numbered(second[first].tolist())


def louvain(n: int, edges: list[tuple[int, int]], m: float | None = None) -> list[int]:
    """The same of edges, repeats allowed."""
    ends = np.array(edges, np.int64).reshape(-1, 2)
    pairs, w = np.unique(ends.min(axis=1) * max(n, 1) + ends.max(axis=1), return_counts=True)
    return louvain_weighted(n, pairs // max(n, 1), pairs % max(n, 1), w.astype(float), float(m or len(edges) or 1))


def _numbered(at: list[int]) -> list[int]:
    names: dict[int, int] = {}
    return [names.setdefault(c, len(names)) for c in at]


def _moved(state: DataFrame, links: DataFrame, m: float) -> DataFrame:
    """state (id, degree, loop, c) -> (id, degree, loop, old, c): where each node gains most, staying where nothing gains more."""
    totals = state.groupBy("c").agg(F.sum("degree").alias("total"))
    near = links.join(state.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id"), "c").agg(F.sum("w").alias("w"))
    choice = near.unionByName(state.select("id", "c", F.col("loop").alias("w"))).groupBy("id", "c").agg(F.sum("w").alias("w"))
    mine = choice.join(totals, "c").join(state.select("id", "degree", "loop", F.col("c").alias("old")), "id")
    others = F.col("total") - F.when(F.col("c") == F.col("old"), F.col("degree")).otherwise(0)
    gain = F.col("w") / F.lit(m) - others * F.col("degree") / F.lit(2 * m * m)
    ranked = mine.select("id", "degree", "loop", "old", F.struct((-gain).alias("loss"), (F.col("c") != F.col("old")).alias("new"), F.col("c").alias("c")).alias("x"))
    best = ranked.groupBy("id").agg(F.first("degree").alias("degree"), F.first("loop").alias("loop"), F.first("old").alias("old"), F.min("x").alias("x"))
    return best.select("id", "degree", "loop", "old", F.col("x.c").alias("c"))


def _quality(state: DataFrame, links: DataFrame, m: float) -> float:
    at = lambda end: state.select(F.col("id").alias(end), F.col("c").alias(f"c{end}"))
    inside = links.join(at("a"), "a").join(at("b"), "b").where("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"))
    loops = state.agg(F.coalesce(F.sum("loop"), F.lit(0.0)).alias("loop"))
    squares = state.groupBy("c").agg(F.sum("degree").alias("d")).agg(F.coalesce(F.sum(F.col("d") * F.col("d")), F.lit(0.0)).alias("d"))
    x = inside.join(F.broadcast(loops)).join(F.broadcast(squares)).first()
    return (x.w / 2 + x.loop) / m - x.d / (4 * m * m)


def _rounds(nodes: DataFrame, links: DataFrame, m: float) -> DataFrame:
    """nodes (id, degree, loop), links (a, b, w; both ways) -> (id, c), moved in rounds until none gains.

    All nodes choose at once, so only a share, by hash, moves in a round, or
    neighbours would change places for ever. When a turn of every share has gained
    nothing, shares get smaller, and with the smallest it ends. What is best so far
    is returned, and each turn must gain, so it does end.
    """
    state = best = save(nodes.select("id", F.col("degree").cast("double").alias("degree"), F.col("loop").cast("double").alias("loop"), F.col("id").alias("c")), "state")
    most = _quality(state, links, m)
    for share in SHARES:
        gained = True
        while gained:
            gained = False
            for turn in range(share):
                mine = F.pmod(F.xxhash64("id"), F.lit(share)) == turn
                moved = save(_moved(state, links, m).select("id", "degree", "loop", F.when(mine, F.col("c")).otherwise(F.col("old")).alias("c")), "state")
                state, quality = moved, _quality(moved, links, m)
                if quality > most + 1e-9:
                    best, most, gained = state, quality, True
            state = best
    return best.select("id", "c")


def _distributed(nodes: DataFrame, links: DataFrame, m: float) -> DataFrame:
    """(id, community id): nodes are moved to a fixpoint, then, once, the communities themselves, as in louvain()."""
    both = F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    weight = F.col("w").cast("double")
    ends = links.select(F.explode(both).alias("x"), weight.alias("w")).select("x.*", "w")
    loop = F.sum(F.when(F.col("a") == F.col("b"), F.col("w") / 2).otherwise(0.0))
    own = save(nodes.select("id").join(ends.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("degree"), loop.alias("loop")), "id"), "own")
    links = save(ends.where("a <> b"), "links")
    first = save(_rounds(own, links, m), "first")
    at = lambda end: first.select(F.col("id").alias(end), F.col("c").alias(f"c{end}"))
    between = save(links.join(at("a"), "a").join(at("b"), "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "between")
    # a link inside is there both ways
    inside = between.where("a = b").select(F.col("a").alias("id"), (F.col("w") / 2).alias("inside"))
    sums = own.join(first, "id").groupBy(F.col("c").alias("id")).agg(F.sum("degree").alias("degree"), F.sum("loop").alias("own"))
    meta = sums.join(inside, "id", "left").select("id", "degree", (F.col("own") + F.coalesce("inside", F.lit(0.0))).alias("loop"))
    second = _rounds(meta, save(between.where("a <> b"), "meta"), m)
    return first.join(second.select(F.col("id").alias("c"), F.col("c").alias("top")), "c").select("id", F.col("top").alias("c"))


def _cluster(members: pa.Table, links: pa.Table, m: float) -> pa.Table:
    """members (id, ord), links (a, b, w) of one task -> (id, c), named by its first member."""
    ids = members.sort_by([("ord", "ascending"), ("id", "ascending")]).column("id").combine_chunks()
    place = lambda end: pc.index_in(links.column(end), value_set=ids).to_numpy().astype(np.int64)
    found = np.array(louvain_weighted(len(ids), place("a"), place("b"), links.column("w").to_numpy().astype(float), m), np.int64)
    _, first = np.unique(found, return_index=True)
    return pa.table({"id": ids, "c": ids.take(pa.array(first[found]))})


class _Sent:
    """Gives tasks what was broadcast."""

    def __init__(self, sent) -> None:
        self.sent = sent

    def __call__(self) -> object:
        return self.sent.value


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b, w), both ways, a loop once, all of an a in one partition -> a row of the partition's nodes, ascending, and their links as bytes."""
    held = [[batch.column(k).to_numpy() for k in range(3)] for batch in batches if batch.num_rows]
    if not held:
        return
    a, b, w = (np.concatenate(x) for x in zip(*held))
    ids, owner = np.unique(a, return_inverse=True)
    loop, n = a == b, len(ids)
    loops = np.bincount(owner[loop], w[loop], n)
    degree = np.bincount(owner, w, n) + loops
    owner, b, w = owner[~loop], b[~loop], w[~loop]
    order = np.argsort(owner, kind="stable")
    start = np.r_[0, np.cumsum(np.bincount(owner, minlength=n))]
    columns = ids.astype(np.int32), degree, loops, start, b[order].astype(np.int32), w[order].astype(np.float64)
    number = int(np.uint64(int(ids[0]) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> np.uint64(40))
    yield pa.record_batch([pa.array([number], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], names=["block", *_BLOCK])


_BLOCK = {"ids": np.int32, "degree": np.float64, "loops": np.float64, "start": np.int64, "to": np.int32, "w": np.float64}
_BLOCK_KINDS = "block int, " + ", ".join(f"{k} binary" for k in _BLOCK)


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield [np.frombuffer(batch.column(k)[i].as_buffer(), kind) for k, kind in _BLOCK.items()]


def _moves(ids: np.ndarray, degree: np.ndarray, loops: np.ndarray, start: np.ndarray, to: np.ndarray, w: np.ndarray, at: np.ndarray, total: np.ndarray, m: float) -> None:
    """Moves a block's nodes to where each gains most, a part of them at a time; at and total (degree by community) follow."""
    n, whole = len(at), 2 * m * m
    cuts = np.unique(np.searchsorted(start, np.arange(0, len(to), max(1, len(to) // SLICES)), "right") - 1)
    for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)]):
        begin, end = start[low], start[high]
        if begin == end:
            continue
        mine, d = ids[low:high], degree[low:high]
        old = at[mine]
        key = np.repeat(np.arange(high - low, dtype=np.int64), np.diff(start[low : high + 1])) * n + at[to[begin:end]]
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sums, (node, c) = np.add.reduceat(w[begin:end][order], first), np.divmod(key[first], n)
        own = c == old[node]
        stay = loops[low:high].copy()
        stay[node[own]] += sums[own]
        stay = stay / m - (total[old] - d) * d / whole
        gain = np.where(own, -np.inf, sums / m - total[c] * d[node] / whole)
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        most = np.maximum.reduceat(gain, starts)
        # of equal gains the first, which is that of the smallest community
        hit = np.flatnonzero(gain == np.repeat(most, np.diff(np.r_[starts, len(node)])))
        _, which = np.unique(node[hit], return_index=True)
        best = hit[which]
        best = best[gain[best] > stay[node[best]] + 1e-15]
        if len(best):
            who, c = node[best], c[best]
            np.subtract.at(total, old[who], d[who])
            np.add.at(total, c, d[who])
            at[mine[who]] = c


def _turn(batches: Iterator[pa.RecordBatch], state: _Sent, m: float) -> Iterator[pa.RecordBatch]:
    """Blocks -> the nodes of each that move, and where to, as bytes."""
    for block in _blocks_of(batches):
        at, total = (x.copy() for x in state())
        ids, before = block[0], state()[0][block[0]]
        _moves(*block, at, total, m)
        moved = at[ids] != before
        yield pa.record_batch([pa.array([x[moved].tobytes()], pa.binary()) for x in (ids, at[ids])], names=["ids", "c"])


def _inside(batches: Iterator[pa.RecordBatch], state: _Sent) -> Iterator[pa.RecordBatch]:
    """Blocks -> the weight of links' ends inside communities."""
    at = state()[0]
    for ids, _, _, start, to, w in _blocks_of(batches):
        same = np.repeat(at[ids], np.diff(start)) == at[to]
        yield pa.record_batch([pa.array([float(w[same].sum())])], names=["w"])


def _in_turns(links: DataFrame, n: int, count: int, m: float) -> np.ndarray:
    """links (a, b, w) of nodes 0 to n - 1 -> their communities, moved until none gains.

    Nodes are dealt to blocks by hash. A turn's blocks move at once, each of its
    nodes in order; all blocks have had a turn when it is told whether that gained.
    Where it hasn't, what was best is taken again with smaller turns, and with the
    smallest it ends.
    """
    blocks = max(1, 2 * count // BLOCK)
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    ends = links.select(F.explode(both).alias("x"), "w").select("x.a", "x.b", "w")
    table = save(ends.repartition(blocks, "a").mapInArrow(_blocked, _BLOCK_KINDS), "blocks")
    names = sorted({row.block for row in table.select("block").collect()})
    degree, loops = np.zeros(n), 0.0
    for row in table.select("ids", "degree", "loops").toLocalIterator():
        degree[np.frombuffer(row.ids, np.int32)] = np.frombuffer(row.degree)
        loops += np.frombuffer(row.loops).sum()

    def told(df: DataFrame, of: Callable, kinds: str, at: np.ndarray) -> list:
        total = np.bincount(at, degree, n)
        sent = df.sparkSession.sparkContext.broadcast((at, total))
        try:
            return df.mapInArrow(partial(of, state=_Sent(sent)), kinds).collect()
        finally:
            sent.destroy()

    def quality(at: np.ndarray) -> float:
        inside = sum(row.w for row in told(table, _inside, "w double", at))
        return (inside / 2 + loops) / m - float((np.bincount(at, degree, n) ** 2).sum()) / (4 * m * m)

    at = np.arange(n, dtype=np.int32)
    best, most = at.copy(), quality(at)
    for turns in TURNS:
        turns, gained = min(turns, len(names)), True
        while gained:
            for turn in range(turns):
                mine = table.where(F.col("block").isin(names[turn::turns])) if turns > 1 else table
                for row in told(mine, partial(_turn, m=m), "ids binary, c binary", at):
                    at[np.frombuffer(row.ids, np.int32)] = np.frombuffer(row.c, np.int32)
            gained = (q := quality(at)) > most + 1e-9
            if gained:
                best, most = at.copy(), q
        at = best.copy()
    return best


def _one_task(batches: Iterator[pa.RecordBatch], m: float) -> Iterator[pa.RecordBatch]:
    """All links (a, b, w) -> (ids, c) as bytes: their nodes, and which each one's community is named by."""
    held = [[batch.column(k).to_numpy() for k in range(3)] for batch in batches if batch.num_rows]
    a, b, w = (np.concatenate(x) for x in zip(*held))
    ids, place = np.unique(np.r_[a, b], return_inverse=True)
    found = _clustered(len(ids), place[: len(a)], place[len(a) :], w.astype(float), m)
    _, first = np.unique(found, return_index=True)
    yield pa.record_batch([pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (ids, ids[first[found]])], names=["ids", "c"])


def _optimised(links: DataFrame, n: int, m: float, local_nodes: int) -> np.ndarray:
    """Communities of nodes 0 to n - 1 after one optimisation, numbered by their first node."""
    count = links.count()
    linked = n if n <= local_nodes or count > LOCAL_LINKS else links.select(F.explode(F.array("a", "b")).alias("x")).distinct().count()
    if linked <= local_nodes and count <= LOCAL_LINKS:
        at = np.arange(n, dtype=np.int32)
        for row in links.select("a", "b", "w").repartition(1).mapInArrow(partial(_one_task, m=m), "ids binary, c binary").collect():
            at[np.frombuffer(row.ids, np.int32)] = np.frombuffer(row.c, np.int32)
    else:
        at = _in_turns(links, n, count, m)
    _, first, which = np.unique(at, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int32)
    rank[np.argsort(first)] = np.arange(len(first), dtype=np.int32)
    return rank[which]


def _renamed(batches: Iterator[pa.RecordBatch], state: _Sent) -> Iterator[pa.RecordBatch]:
    """Links of nodes -> links of their communities, summed by batch."""
    at = state().astype(np.int64)
    for batch in batches:
        a, b = at[batch.column("a").to_numpy()], at[batch.column("b").to_numpy()]
        pairs, which = np.unique(np.minimum(a, b) << 32 | np.maximum(a, b), return_inverse=True)
        sums = np.bincount(which, batch.column("w").to_numpy(), len(pairs)).astype(np.int64)
        yield pa.record_batch([pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(sums)], names=["a", "b", "w"])


def _given(batches: Iterator[pa.RecordBatch], state: _Sent) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column("id"), pa.array(state()[batch.column("num").to_numpy()].astype(np.int64))], names=["id", "community"])


def _by_number(nodes: DataFrame, edges: DataFrame, local_nodes: int) -> DataFrame:
    """assign_communities() of many nodes, which are numbered by ord: links are pairs of numbers, and communities an array."""
    ranged = save(nodes.groupBy("id").agg(F.min("ord").alias("ord")).repartitionByRange("ord", "id").sortWithinPartitions("ord", "id").withColumn("part", F.spark_partition_id()), "ranged")
    sizes = {row.part: row["count"] for row in ranged.groupBy("part").count().collect()}
    n, starts = sum(sizes.values()), {part: sum(v for k, v in sizes.items() if k < part) for part in sizes}
    start = ranged.sparkSession.createDataFrame([*starts.items()], "part int, start bigint")
    nth = F.row_number().over(Window.partitionBy("part").orderBy("ord", "id")) - 1
    numbered = save(ranged.withColumn("nth", nth).join(F.broadcast(start), "part").select("id", (F.col("start") + F.col("nth")).cast("int").alias("num")), "numbered")
    # valid edges are dealt by to_id already, and nodes are few beside them, so no edge is sorted
    at = lambda end, name: numbered.select(F.col("id").alias(end), F.col("num").alias(name)).hint("shuffle_hash")
    ends = edges.select("from_id", "to_id").join(at("to_id", "v"), "to_id").select("from_id", "v").join(at("from_id", "u"), "from_id").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    links = save(ends.groupBy("a", "b").agg(F.count("*").alias("w")), "weighted")
    m = float(links.agg(F.sum("w")).first()[0] or 0)
    sc, found = links.sparkSession.sparkContext, np.arange(n, dtype=np.int32)
    if m:
        found = _optimised(links, n, m, local_nodes)
        sent = sc.broadcast(found)
        meta = save(links.mapInArrow(partial(_renamed, state=_Sent(sent)), "a int, b int, w bigint").groupBy("a", "b").agg(F.sum("w").alias("w")), "meta")
        sent.destroy()
        # communities are numbered by their first node, so these are too
        found = _optimised(meta, int(found.max()) + 1, m, local_nodes)[found]
    given = numbered.mapInArrow(partial(_given, state=_Sent(sc.broadcast(found))), "id string, community bigint")
    return nodes.drop("community").join(given, "id").select(*nodes.columns)


def assign_communities(nodes: DataFrame, edges: DataFrame, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """nodes with community set, numbered from 0 by the first member's ord.

    Equal edges become one link with their number first, so their repeats are only
    read once. Components can't gain from each other, so all go to one task, in the
    order of ord, if they have few nodes together. Otherwise each is clustered by
    itself: small ones in a task each, larger ones by rounds of joins. Both move
    nodes until none gains, then the communities once in the same way; which of
    several such partitions it is depends on the order of moves, and so on the form.
    A node without edges is a community. Of more than local_nodes and up to NUMBERED nodes, see _by_number().
    """
    if local_nodes < nodes.count() <= NUMBERED:
        return _by_number(nodes, edges, local_nodes)
    ends = edges.select(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b"))
    links = save(ends.groupBy("a", "b").agg(F.count("*").alias("w")), "weighted")
    m = links.agg(F.sum("w")).first()[0] or 0
    if m == 0:
        found = nodes.select("id", F.col("id").alias("c"))
    else:
        linked = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        placed = save(nodes.select("id", "ord").join(linked, "id", "left_semi"), "linked")
        large, inner, small = None, links.withColumn("root", F.lit("")), placed.withColumn("root", F.lit(""))
        if placed.count() > local_nodes or links.count() > LOCAL_LINKS:
            roots = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
            rooted = save(placed.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")
            inside = save(links.join(rooted.select(F.col("id").alias("a"), "root"), "a"), "inside")
            sizes = rooted.groupBy("root").agg(F.count("*").alias("n")).join(inside.groupBy("root").agg(F.count("*").alias("links")), "root")
            sizes = save(sizes.select("root", ((F.col("n") <= local_nodes) & (F.col("links") <= LOCAL_LINKS)).alias("few")), "sizes")
            small, inner = (df.join(sizes.where("few"), "root", "left_semi") for df in (rooted, inside))
            large = (df.join(sizes.where("not few"), "root", "left_semi").drop("root") for df in (rooted, inside)) if not sizes.where("not few").isEmpty() else None
        tasks = small.select("root", "id", "ord").groupBy("root").cogroup(inner.select("root", "a", "b", "w").groupBy("root"))
        found = tasks.applyInArrow(partial(_cluster, m=float(m)), "id string, c string")
        if large is not None:
            found = found.unionByName(_distributed(*large, float(m)))
        lonely = nodes.select("id").join(placed, "id", "left_anti")
        found = found.unionByName(lonely.select("id", F.col("id").alias("c")))
    named = save(nodes.select("id", "ord").join(found, "id"), "found")
    first = named.groupBy("c").agg(F.min(F.struct("ord", "id")).alias("first"))
    # one row per community, numbered by range partitions and their counts
    ranged = first.repartitionByRange(F.col("first")).sortWithinPartitions("first").withColumn("part", F.spark_partition_id())
    ranged = save(ranged, "ranged")
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    starts = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1
    numbers = ranged.withColumn("nth", nth).join(F.broadcast(starts), "part").select("c", (F.col("start") + F.col("nth")).cast("bigint").alias("community"))
    return nodes.drop("community").join(named.select("id", "c").join(numbers, "c").select("id", "community"), "id").select(*nodes.columns)
