"""Connected components by pointer jumping and hooking to least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.staging import stage, unstage


def _nodes(edges: DataFrame) -> DataFrame:
    """(node, low, moves): each node's least smaller neighbour, null if there is
    none, and whether an edge has to change there, as the node has several smaller
    neighbours or is itself one of another node; edges have u > v."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("low"), F.lit(False).alias("below")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(None).alias("low"), F.lit(True).alias("below"))
    )
    found = ends.groupBy("node").agg(F.min("low").alias("low"), F.max("low").alias("high"), F.max("below").alias("below"))
    return found.select("node", "low", (F.col("low").isNotNull() & (F.col("below") | (F.col("low") != F.col("high")))).alias("moves"))


def _moved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each node's edge to its least neighbour goes on to that one's own, every
    other edge links the two ends' least neighbours.

    An edge makes one edge at most. Following the least neighbours leads every
    node to the same end as before, so nothing is disconnected.
    """
    moving = nodes.filter("moves")
    u, v = (moving.select(F.col("node").alias(end), F.col("low").alias(f"low_{end}")) for end in "uv")
    x, y = F.coalesce("low_u", "v"), F.coalesce("low_v", "v")
    is_least = F.col("v") == x
    moved = edges.join(v, "v", "left").join(u, "u", "left")
    return moved.select(F.when(is_least, F.col("u")).otherwise(F.greatest(x, y)).alias("u"), F.when(is_least, y).otherwise(F.least(x, y)).alias("v")).filter("u <> v")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with a link to another; the root is the component's least node.

    Null ends and links of a node to itself are ignored; repeated links are harmless.
    """
    edges = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = stage(edges, "links")
    nodes = stage(_nodes(edges), "nodes")
    while not nodes.filter("moves").isEmpty():
        moved = stage(_moved(edges, nodes), "moved-links")
        for used in (edges, nodes):
            unstage(used)
        edges, nodes = moved, stage(_nodes(moved), "nodes")
    unstage(edges)
    return nodes.select("node", F.coalesce("low", "node").alias("root"))


def joined_components(roots: DataFrame, more: DataFrame) -> DataFrame:
    """``roots`` (node, root) of earlier links, with the links (a, b) of ``more`` added."""
    if more.isEmpty():
        return roots
    return connected_components(more.select("a", "b").unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
