"""Connected components by alternating star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, partitions


#: Edges whose nodes' minima are few enough to send to every task.
FEW_EDGES = 200_000


def _beside(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """edges (a, b) with a's minimum m; least has (a, m, c), c the edges of a.

    Few minima are sent. Of many, only those of nodes with more edges than a quarter of
    an even share of a partition are sent, of which there can be but a few for each
    partition; so no task meets all edges of a component's centre.
    """
    if n <= FEW_EDGES:
        return edges.join(F.broadcast(least.drop("c")), "a")
    least = cut(least)
    hot = F.broadcast(least.where(F.col("c") > max(1000, n // (4 * partitions(edges.sparkSession)))).drop("c"))
    return edges.join(hot, "a").unionByName(edges.join(hot.select("a"), "a", "left_anti").join(least.drop("c"), "a"))


def _large_star(e: DataFrame, n: int) -> DataFrame:
    both = e.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("c"))
    return _beside(both, least, 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame, n: int) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c"))
    # Every node has an edge to its minimum, which stands for the node's own.
    return _beside(down, least, n).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))


def _unsettled(e: DataFrame) -> tuple[int, int]:
    """The number of edges (a, b), a > b, and of nodes that keep them from being stars round their components' smallest nodes."""
    ends = e.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return tuple(nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if(F.col("up") + F.col("down") > 1)).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node of node's component.

    edges has the two node columns first; order and repeats do not matter and a
    null node is left out. Nodes without any edge are not in the result. Every
    round is cut in the shared folder, so a lost executor costs one round; edges that
    are stars already take none. No node's neighbours are ever gathered: all steps are grouped minima and joins.
    """
    a, b = edges.columns[:2]
    e = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    n, left = _unsettled(e)
    for _ in range(most_rounds):
        if not left:
            break
        e = cut(_small_star(_large_star(e, n), n).distinct())
        n, left = _unsettled(e)
    if not left:
        return e.toDF("node", "root")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
