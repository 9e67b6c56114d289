"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import save


def _unfinished(e: DataFrame) -> bool:
    """Whether some node hangs on two others, or on one that hangs on another."""
    ends = F.array(F.struct(F.col("hi").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")), F.struct(F.col("lo").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    nodes = e.select(F.explode(ends).alias("x")).select("x.*").groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return not nodes.where("hangs + holds > 1").where("hangs > 0").isEmpty()


def _star(links: DataFrame) -> DataFrame:
    """links (a, b): every b of a is tied to the least of a and its b's instead."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return links.join(least, "a")


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) of any order, repeats and loops allowed -> (node, root).

    Alternates large and small stars until every node hangs directly on the least
    node of its component, which takes about log(n) rounds. All of it is grouped
    minima and equality joins; a node with very many links is a skewed join that
    adaptive execution splits. Nodes without a link to another are not returned.
    """
    e = save(
        edges.where("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct(),
        "edges",
    )
    while _unfinished(e):
        both = e.select(F.col("hi").alias("a"), F.col("lo").alias("b")).union(e.select("lo", "hi"))
        large = _star(both).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        starred = _star(large)
        small = starred.where("b <> m").select(F.col("b").alias("hi"), F.col("m").alias("lo")).union(
            starred.select(F.col("a").alias("hi"), F.col("m").alias("lo"))
        )
        e = save(small.distinct(), "edges")
    roots = e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.union(e.select("lo", "lo").distinct())
