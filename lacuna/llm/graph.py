"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize

#: A node with at least so many neighbours, or with this share of all ends of edges, is hot: at most SHARE nodes can be.
HOT, SHARE = 1 << 10, 1 << 12


def _hang(ends: DataFrame, least: DataFrame, bound: int, most: int, key: str) -> DataFrame:
    """The rows of ``ends`` with m, the aggregate of their key; rows of hot keys meet it by broadcast and are not moved.
    No key has more than ``most`` rows."""
    if most < bound:
        return ends.join(least.select(key, "m"), key).select("a", "b", "m")
    hot = F.broadcast(least.where(F.col("d") >= bound).select(key, F.col("m").alias("hot")))
    marked = ends.join(hot, key, "left")
    cold = marked.where("hot is null").join(least.where(F.col("d") < bound).select(key, "m"), key)
    return marked.where("hot is not null").select("a", "b", F.col("hot").alias("m")).union(cold.select("a", "b", "m"))


def _pairs(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Of every row the named pairs of columns, as rows (a, b)."""
    return rows.select(F.inline(F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs))))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node of the edges (a, b), both long; root is the smallest node of the component.

    Alternates large-star and small-star steps: every node's larger, then its smaller neighbours are hung on the
    smallest one, which halves the longest path in a pair of steps and ends with stars. The smallest neighbour is an
    aggregate that is joined back. Nodes with more neighbours than a share of all edges are at most SHARE in number, so
    they are broadcast, and the rows of a hub stay where they are; the rows of any other node are fewer than that
    share. The search ends as soon as every node with a smaller neighbour has no other, so that no round is made to see
    that nothing changes. Each round is written to the shared folder and the one before it deleted; only three numbers
    reach the driver.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialize(edges, name)
    while True:
        both = _pairs(edges, ("a", "b"), ("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("d"))
        least = materialize(least, f"{name}-least")
        ends, most, inner = least.agg(F.coalesce(F.sum("d"), F.lit(0)), F.coalesce(F.max("d"), F.lit(0)), F.count_if(F.expr("m < a and d > 1"))).first()
        if not inner:
            discard(edges)
            return least.select(F.col("a").alias("node"), F.col("m").alias("root"))
        bound = max(HOT, -(-ends // SHARE))
        # Large star: larger neighbours meet the smallest of the node and its neighbours. A row keeps its larger end.
        large = _hang(edges, least, bound, most, "a").select(F.col("m").alias("a"), "b")
        # Small star: the node and its smaller neighbours meet the smallest of them.
        lower = large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("d"))
        hung = _hang(large, lower, bound, most, "b")
        old, edges = edges, materialize(_pairs(hung, ("m", "b"), ("m", "a")).where("a <> b").distinct(), name)
        discard(old, least)
