"""Connected components of an undirected graph, as DataFrame joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelstate.llm.common import saved


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, component`` of all nodes with an edge; the component is its smallest node.

    ``edges`` has the columns ``a`` and ``b``. Every round links each node's greater neighbours, and
    then its smaller ones, to the smallest node around it, until no edge changes; the number of rounds
    grows with the logarithm of the longest path. A node's edges are only ever reduced to a
    minimum, which is combined before the shuffle, so that a node with many edges does not weigh
    on one task. The edges of each round are written to the shared scratch folder.
    """
    edges = edges.where(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = saved(edges, "edges")
    before = None
    for _ in range(rounds):
        large = _linked(edges, large=True)
        edges = saved(_linked(large, large=False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    found = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return found.unionByName(roots)


def _linked(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges with ``a < b``: neighbours are linked to the smallest around.

    The large step looks at all neighbours of a node and moves the greater ones; the small step looks
    at the smaller ones and moves these and the node itself.
    """
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if large:
        both = down.unionByName(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low"))
        least = least.select(F.col("u").alias("of"), F.least("u", "low").alias("low"))
        moved = both.where(F.col("v") > F.col("u"))
    else:
        least = down.groupBy("u").agg(F.min("v").alias("low"))
        least = least.withColumnRenamed("u", "of")
        moved = down.unionByName(
            least.select(F.col("of").alias("u"), F.col("of").alias("v")))
    joined = moved.join(least, moved["u"] == least["of"])
    out = joined.select(F.col("low").alias("a"), F.col("v").alias("b"))
    return out.where(F.col("a") != F.col("b")).distinct()
