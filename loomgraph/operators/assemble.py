"""Node and edge tables of a code graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.join import shuffled

EXTRACTED, INFERRED = "Extracted", "Inferred"
ROUTE_SCORE = 0.6


def route_id() -> Column:
    return F.concat("file", F.lit("::route::"), "method", F.lit("::"), "path")


def model_id() -> Column:
    return F.concat(F.lit("schema::"), F.lower(F.coalesce("table_name", "name")))


def dedup_nodes(nodes: DataFrame) -> DataFrame:
    """The last row of each id, by ord, with hash aggregation ahead of the shuffle."""
    rest = [c for c in nodes.columns if c != "id"]
    last = nodes.groupBy("id").agg(F.max_by(F.struct(*rest), "ord").alias("last"))
    return last.select("id", "last.*").select(*nodes.columns)


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """nodes with new ones, which replace the data of those with their id but keep the place."""
    keep = nodes.join(new.select("id"), "id", "left_anti")
    place = nodes.groupBy("id").agg(F.min("ord").alias("__place"))
    moved = new.join(place, "id", "left").withColumn("ord", F.coalesce("__place", "ord")).select(*nodes.columns)
    return keep.unionByName(dedup_nodes(moved))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are nodes; parallel ones stay."""
    ids = shuffled(nodes.select("id").distinct())
    return edges.join(ids, edges["from_id"] == ids["id"], "left_semi").join(ids, edges["to_id"] == ids["id"], "left_semi")


def module_nodes(files: DataFrame) -> DataFrame:
    """A node for each file, so that imports have ends."""
    return files.select(
        F.concat("relative", F.lit("::__module__")).alias("id"), F.col("relative").alias("label"), F.lit("Module").alias("node_type"),
        F.col("relative").alias("file"), F.lit(1).alias("line"), F.lit(0).cast("bigint").alias("community"), (F.col("ord") * (1 << 20)).alias("ord"),
    )


def module_edges(imports: DataFrame) -> DataFrame:
    end = lambda c: F.concat(c, F.lit("::__module__"))
    return imports.select(
        end("from_file").alias("from_id"), end("to_file").alias("to_id"), F.lit("Imports").alias("kind"),
        F.lit(EXTRACTED).alias("conf_class"), F.lit(1.0).cast("float").alias("conf_score"), F.lit(0).cast("bigint").alias("ord"),
    )


def build_graph(symbols: tuple[DataFrame, DataFrame], routes: DataFrame, models: DataFrame, semantic: tuple[DataFrame, DataFrame] | None = None, modules: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of symbols, then documents, then routes and models, later ones replacing earlier of their id.

    A route points to the symbols of its file that its path's segments name. Edges
    without two known ends are dropped.
    """
    base = 1 << 50  # routes and models come behind all symbols
    nodes, edges = symbols
    for more in (semantic, modules):
        if more is not None:
            nodes, edges = nodes.unionByName(more[0]), edges.unionByName(more[1])
    node = lambda id_, label, kind, file, ord_: [id_.alias("id"), label.alias("label"), F.lit(kind).alias("node_type"), file.alias("file"), F.lit(0).alias("line"), F.lit(0).cast("bigint").alias("community"), ord_.alias("ord")]
    nodes = nodes.unionByName(routes.select(*node(route_id(), F.concat_ws(" ", "method", "path"), "Route", F.col("file"), F.col("ord") + base)))
    nodes = nodes.unionByName(models.select(*node(model_id(), F.col("name"), "Schema", F.lit(""), F.col("ord") + 2 * base)))
    tagged = routes.select(route_id().alias("from_id"), "file", F.explode("tags").alias("tag"), "ord")
    edges = edges.unionByName(
        tagged.select(
            "from_id", F.concat("file", F.lit("::"), "tag").alias("to_id"), F.lit("Contains").alias("kind"),
            F.lit(INFERRED).alias("conf_class"), F.lit(ROUTE_SCORE).cast("float").alias("conf_score"), (F.col("ord") + base).alias("ord"),
        )
    )
    kept = dedup_nodes(nodes)
    return kept, valid_edges(edges, kept)


def get_node(nodes: DataFrame, id_: str) -> DataFrame:
    return nodes.where(F.col("id") == id_)


def nodes_of_type(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.col("node_type") == kind)


def neighbours(nodes: DataFrame, edges: DataFrame, id_: str, direction: str = "out") -> DataFrame:
    """The nodes one edge away, with the edge's kind and confidence; direction out, in or both."""
    parts = []
    for way, here, there in (("out", "from_id", "to_id"), ("in", "to_id", "from_id")):
        if direction in (way, "both"):
            parts.append(edges.where(F.col(here) == id_).select(F.col(there).alias("id"), "kind", "conf_class", "conf_score", F.col("ord").alias("edge_ord"), F.lit(way).alias("direction")))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return found.join(nodes, "id")
