"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every neighbour of a node (the larger ones, or the smaller ones and the node) to the least of them.

    The least neighbour comes from an aggregate with a map-side combine, and is joined back: a node
    with very many neighbours is never one group in one task.
    """
    if large:
        both = edges.select("a", "b").unionByName(edges.selectExpr("b as a", "a as b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.where("b > a").join(least, "a").selectExpr("m as a", "b").where("a <> b")
    down = edges.selectExpr("b as a", "a as b")  # a > b
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return joined.selectExpr("m as a", "b").where("a <> b").unionByName(least.selectExpr("m as a", "a as b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of longs -> (id, component) for every node with a link; the component is its least node.

    Repeated links, links in either direction and links of a node to itself are allowed; without links
    there are no rows.
    """

    def mark(edges):
        h = F.xxhash64("a", "b")
        return edges.agg(F.count("*"), F.bit_xor(h), F.sum(h % 1_000_003)).first()

    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = mark(edges)
    while True:
        new = stored(_star(_star(edges, True), False), "links")
        dropped(edges)
        edges, after = new, mark(new)
        if before == after:  # a step that changes no link: every node hangs on the least of its component
            return edges.selectExpr("b as id", "a as component").unionByName(edges.selectExpr("a as id", "a as component").distinct())
        before = after
