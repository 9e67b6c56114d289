"""Walks over a code graph: neighbourhoods under a budget, change impact, callers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.join import contains_join, shuffled
from ..schema import NODE_TAGS
from ..sources.scratch import save
from .analytics import degrees, god_nodes

#: Steps of a walk that stay one plan; of a longer one each level is a table in the shared folder.
FUSED_LEVELS = 1
#: Bytes of a line at least, which bounds the lines that a budget can hold.
LEAST_LINE = 8
#: Neighbours that a node's line names.
SHOWN = 4


def levels(links: DataFrame, seeds: DataFrame, depth: int | None) -> DataFrame:
    """links (src, dst), seeds (id) -> id, depth: nodes within so many steps, with the fewest.

    Each level is one join of the frontier and an anti join with what has been
    seen. Of a longer walk links and levels, which are needed more than once, are
    written to the shared folder rather than planned again; it ends when a level
    is empty.
    """
    seen = seeds.select("id", F.lit(0).alias("depth")).distinct()
    fused = depth is not None and depth <= FUSED_LEVELS
    seen = seen if fused else save(seen, "seen")
    frontier = seen
    if not fused:
        # what finds the links may cost more than the walk, so it is done once
        links = save(links.select("src", "dst"), "links")
    step = 0
    while depth is None or step < depth:
        step += 1
        reached = links.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(step))
        if not fused:
            frontier = save(frontier, "frontier")
            if frontier.isEmpty():
                break
        # levels stay as they were written: what has been seen is their union
        seen = seen.unionByName(frontier)
    return seen


def seed_nodes(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose label or file holds any of the query's words, in any case."""
    hit = F.lit(False)
    for term in query.lower().split():
        hit = hit | F.contains(F.lower("label"), F.lit(term)) | F.contains(F.lower("file"), F.lit(term))
    return nodes.where(hit)


def resolve_seeds(nodes: DataFrame, edges: DataFrame, query: str) -> DataFrame:
    """seed_nodes, or the five most connected nodes where no node matches."""
    seeds = seed_nodes(nodes, query)
    return god_nodes(nodes, edges, 5).select(*nodes.columns) if seeds.isEmpty() else seeds


def both_ways(edges: DataFrame, direction: str) -> DataFrame:
    out = edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    back = edges.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))
    return {"out": out, "in": back}.get(direction, out.unionByName(back))


def node_lines(visited: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """visited rows of nodes and, as line, how each is shown: tag, label, place and the first neighbours."""
    tag = F.element_at(F.create_map(*(F.lit(x) for pair in NODE_TAGS.items() for x in pair)), F.col("node_type"))
    place = F.when(F.col("line") > 0, F.concat_ws(":", "file", "line")).otherwise(F.col("file"))
    order = Window.partitionBy("id").orderBy("ord", "to_id")
    first = edges.join(visited.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("from_id").alias("id"), "to_id", "ord")
    first = first.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SHOWN)
    labels = first.join(nodes.select(F.col("id").alias("to_id"), "label"), "to_id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("nth", "label"))).alias("shown"))
    shown = F.array_join(F.col("shown")["label"], ", ")
    head = F.concat(F.lit("  ["), tag, F.lit("] "), F.col("label"), F.lit(" ["), place, F.lit("]"))
    text = F.when(F.size("shown") > 0, F.concat(head, F.lit(" → "), shown)).otherwise(head)
    return visited.join(labels, "id", "left").withColumn("shown_line", text).drop("shown", "line").withColumnRenamed("shown_line", "line")


def within_budget(lines: DataFrame, max_tokens: int, *order: str) -> DataFrame:
    """Lines, in order, up to the first that the budget of three bytes a token can't hold; the first always stays.

    Adds nth and truncated. A line takes LEAST_LINE bytes at least, so the ordered
    window sees a top-k of fixed size and not all that was visited.
    """
    budget = 3 * max_tokens
    some = lines.orderBy(*order).limit(budget // LEAST_LINE + 2)
    w = Window.orderBy(*order)
    run = some.withColumn("nth", F.row_number().over(w)).withColumn("bytes", F.sum(F.octet_length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fits = (F.col("bytes") <= budget) | (F.col("nth") == 1)
    marked = run.withColumn("truncated", F.max(~fits).over(Window.partitionBy(F.lit(0))))
    return marked.where(fits)


def bfs_context(nodes: DataFrame, edges: DataFrame, query: str, max_tokens: int, direction: str = "both", depth: int | None = None) -> DataFrame:
    """nth, id, depth, line, truncated: what a breadth-first walk from the query's seeds shows within the budget.

    Nodes are visited by depth, then ord. Since a level is shown before the next,
    the walk needs no more levels than the budget has room for.
    """
    seeds = resolve_seeds(nodes, edges, query)
    most = 3 * max_tokens // LEAST_LINE + 2
    depth = most if depth is None else min(depth, most)
    reached = levels(both_ways(edges, direction), seeds, depth)
    # more nodes than the budget holds are never shown
    visited = reached.join(nodes, "id").orderBy("depth", "ord", "id").limit(most)
    return within_budget(node_lines(visited, nodes, edges), max_tokens, "depth", "ord", "id").select("nth", "id", "depth", "line", "truncated")


def dfs_order(links: list[tuple[str, str]], seeds: list[str]) -> list[str]:
    """The order in which a stack, filled with the seeds, visits nodes; links in the order of their edges."""
    following: dict[str, list[str]] = {}
    for src, dst in links:
        following.setdefault(src, []).append(dst)
    stack, seen, order = list(seeds), set(), []
    while stack:
        if (at := stack.pop()) in seen:
            continue
        seen.add(at)
        order.append(at)
        stack.extend(x for x in following.get(at, ()) if x not in seen)
    return order


def dfs_context(nodes: DataFrame, edges: DataFrame, query: str, max_tokens: int, depth: int | None = None) -> DataFrame:
    """As bfs_context, for a depth-first walk along outgoing edges.

    The order depends on every step before, so the walk itself is one task's, over
    the edges of nodes that the seeds reach; all else is distributed.
    """
    seeds = resolve_seeds(nodes, edges, query)
    reached = levels(both_ways(edges, "out"), seeds, depth)
    inside = edges.join(reached.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    rows = inside.select(F.lit("e").alias("t"), F.col("from_id").alias("a"), F.col("to_id").alias("b"), "ord").unionByName(
        seeds.select(F.lit("s").alias("t"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), "ord")
    )

    def walk(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["ord", "a", "b"], kind="stable")
        links = pdf[pdf["t"] == "e"]
        order = dfs_order(list(zip(links["a"], links["b"])), pdf[pdf["t"] == "s"]["a"].tolist())
        return pd.DataFrame({"id": order, "visit": range(len(order))})

    order = rows.withColumn("whole", F.lit(0)).groupBy("whole").applyInPandas(walk, "id string, visit bigint")
    visited = order.join(nodes, "id").orderBy("visit").limit(3 * max_tokens // LEAST_LINE + 2)
    return within_budget(node_lines(visited, nodes, edges), max_tokens, "visit").select("nth", "id", "visit", "line", "truncated")


def blast_files(imports: DataFrame, sources: DataFrame | list[str], max_depth: int) -> DataFrame:
    """imports (from_file, to_file) -> file, depth: what a change of the source files can touch.

    max_depth counts levels with that of the sources: 1 gives the sources alone, 0 nothing.
    """
    if not isinstance(sources, DataFrame):
        sources = imports.sparkSession.createDataFrame([(s,) for s in sources], "id string")
    if max_depth < 1:
        return sources.limit(0).select(F.col("id").alias("file"), F.lit(0).alias("depth"))
    links = imports.select(F.col("to_file").alias("src"), F.col("from_file").alias("dst"))
    return levels(links, sources, max_depth - 1).withColumnRenamed("id", "file")


def blast_routes(routes: DataFrame, files: DataFrame) -> DataFrame:
    return routes.join(files.select("file"), "file", "left_semi").select(*routes.columns)


def blast_models(models: DataFrame, files: DataFrame) -> DataFrame:
    """name of models that some touched file's path holds, in any case."""
    hits = contains_join(files.select(F.lower("file").alias("file")), "file", models.select(F.lower("name").alias("name")), "name")
    names = models.select("name", F.lower("name").alias("needle"))
    return names.join(shuffled(hits.select("needle").distinct()), "needle", "left_semi").select("name").distinct()


def callers(edges: DataFrame, targets: DataFrame, max_depth: int) -> DataFrame:
    """id, depth: who calls the targets, 1 to max_depth calls away; targets left out."""
    links = edges.where(F.col("kind") == "Calls").select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))
    return levels(links, targets.select("id"), max_depth).where(F.col("depth") > 0)


def best_symbol(nodes: DataFrame, edges: DataFrame, query: str) -> DataFrame:
    """The most connected node whose label holds the query, ties by ord; no row if none does."""
    hits = nodes.where(F.contains(F.lower("label"), F.lit(query.lower())))
    return degrees(hits, edges).orderBy(F.desc("degree"), "ord", "id").limit(1)


def symbol_callers(nodes: DataFrame, edges: DataFrame, query: str, max_depth: int) -> DataFrame:
    """id, label, file, line, depth of the best symbol's callers, by depth and file."""
    found = callers(edges, best_symbol(nodes, edges, query), max_depth)
    return found.join(nodes, "id").orderBy("depth", "file", "ord", "id").select("id", "label", "file", "line", "depth")
