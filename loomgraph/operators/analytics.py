"""Measures of a code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import top_dir


def ends(edges: DataFrame) -> DataFrame:
    """Both ends of every edge, a row each."""
    return edges.select(F.explode(F.array("from_id", "to_id")).alias("id"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with degree: edges in and out, a loop twice."""
    counts = ends(edges).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.join(counts, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def god_nodes(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """The n most connected nodes, ties by ord."""
    return degrees(nodes, edges).orderBy(F.desc("degree"), "ord", "id").limit(n)


def orphan_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge that are neither routes nor schemas."""
    return nodes.where(~F.col("node_type").isin("Route", "Schema")).join(ends(edges), "id", "left_anti")


def ambiguous_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes to which some ambiguous edge points."""
    doubtful = edges.where(F.col("conf_class") == "Ambiguous").select(F.col("to_id").alias("id"))
    return nodes.join(doubtful, "id", "left_semi")


def cross_community_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between communities, from any but community 0."""
    at = lambda end: nodes.select(F.col("id").alias(f"{end}_id"), F.col("label").alias(f"{end}_label"), F.col("file").alias(f"{end}_file"), F.col("community").alias(f"{end}_community"))
    both = edges.select("from_id", "to_id", "kind").join(at("from"), "from_id").join(at("to"), "to_id")
    return both.where((F.col("from_community") != F.col("to_community")) & (F.col("from_community") != 0))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts; communities count as 0 where there is but one."""
    kinds = nodes.agg(
        F.count("*").alias("node_count"),
        F.count_if(F.col("node_type").isin("Function", "Method")).alias("function_count"),
        F.count_if(F.col("node_type") == "Route").alias("route_count"),
        F.count_if(F.col("node_type") == "Schema").alias("schema_count"),
        F.countDistinct("community").alias("n"),
    )
    total = edges.agg(F.count("*").alias("edge_count"))
    return kinds.join(F.broadcast(total)).select(
        "node_count", "edge_count", "function_count", "route_count", "schema_count", F.when(F.col("n") > 1, F.col("n")).otherwise(0).alias("community_count")
    )


def community_summary(nodes: DataFrame) -> DataFrame:
    """id, size and label of each community, largest first; no row where there is but one.

    The label is the folder that most members lie in, ties by name.
    """
    folders = nodes.select("community", F.when(F.col("file") != "", top_dir(F.col("file"))).alias("folder"))
    counts = folders.groupBy("community", "folder").agg(F.count("*").alias("n"))
    most = F.min(F.when(F.col("folder").isNotNull(), F.struct((-F.col("n")).alias("n"), "folder")))["folder"]
    each = counts.groupBy("community").agg(F.sum("n").alias("size"), most.alias("folder"))
    name = F.coalesce("folder", F.concat(F.lit("community_"), "community"))
    labelled = each.select(F.col("community").alias("id"), "size", F.concat(name, F.lit(" ("), "size", F.lit(")")).alias("label"))
    several = labelled.withColumn("groups", F.count("*").over(Window.partitionBy(F.lit(0))))
    return several.where("groups > 1").drop("groups").orderBy(F.desc("size"), "id")


def modularity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, q: the modularity of nodes' communities, of edges without direction."""
    of = nodes.select("id", "community")
    inside = (
        edges.join(of.select(F.col("id").alias("from_id"), F.col("community").alias("a")), "from_id")
        .join(of.select(F.col("id").alias("to_id"), F.col("community").alias("b")), "to_id")
        .agg(F.count("*").alias("m"), F.count_if(F.col("a") == F.col("b")).alias("inside"))
    )
    degree = degrees(of, edges).groupBy("community").agg(F.sum("degree").alias("d"))
    squares = degree.agg(F.sum(F.col("d").cast("double") * F.col("d")).alias("squares"))
    return inside.join(F.broadcast(squares)).select((F.col("inside") / F.col("m") - F.col("squares") / (4.0 * F.col("m") * F.col("m"))).alias("q"))


def token_stats(routes: DataFrame, models: DataFrame, files: DataFrame, hot: DataFrame) -> DataFrame:
    """One row: counts, and the tokens that the context block of a scan is expected to take."""
    one = routes.agg(F.count("*").alias("route_count"))
    for df, name in ((models, "schema_count"), (files, "file_count"), (hot, "hot_file_count")):
        one = one.join(F.broadcast(df.agg(F.count("*").alias(name))))
    estimate = 40 + 15 * F.least("route_count", F.lit(15)) + 20 * F.least("schema_count", F.lit(10)) + 10 * F.least("hot_file_count", F.lit(5))
    return one.select(estimate.alias("estimated_context_tokens"), "route_count", "schema_count", "file_count", "hot_file_count")
