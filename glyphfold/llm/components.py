"""Connected components of large graphs by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphfold.session import cut_lineage

#: Edges are narrow; this many make one task, whatever the number of shuffle partitions.
EDGES_PER_TASK = 500_000


def _lowest(edges: DataFrame, tasks: int) -> DataFrame:
    """(a, low): the smallest second end of each first end; written, so that a hub's edges can be split in a join."""
    return cut_lineage(edges.groupBy("a").agg(F.min("b").alias("low")).coalesce(tasks))


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Larger neighbours of a node move to the smallest of it and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
    met = both.join(_lowest(both, tasks), "a").filter(F.col("b") > F.col("a"))
    return met.select(F.col("b").alias("a"), F.least("a", "low").alias("b")).coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Smaller neighbours of a node, and the node, move to the smallest of them."""
    met = edges.join(_lowest(edges, tasks), "a").coalesce(tasks)
    moved = F.when(F.col("b") > F.col("low"), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))
    itself = F.struct(F.col("a").alias("a"), F.col("low").alias("b"))
    return met.select(F.inline(F.array_compact(F.array(moved, itself))))


def _open_nodes(edges: DataFrame) -> tuple[int, int]:
    """(edges, nodes that are not at rest): a node rests if it is only a centre, or the end of one edge only."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up")), F.struct(F.col("b").alias("n"), F.lit(0).alias("up")))))
    per_node = ends.groupBy("n").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("all"))
    moving = (F.col("up") > 1) | ((F.col("up") > 0) & (F.col("all") > F.col("up")))
    found = per_node.agg(F.sum("up"), F.count_if(moving)).first()
    return int(found[0] or 0), int(found[1] or 0)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of an edge (a, b) can reach.

    Rounds go on until every edge leads to the centre of a star, which is the
    smallest node of its component; their number grows with the logarithm of
    the number of nodes.  Edges are written between rounds.  Edges from a node
    to itself are ignored.
    """
    oriented = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = cut_lineage(oriented.distinct())
    while True:
        # Two numbers for the driver.
        count, moving = _open_nodes(current)
        tasks = 1 + count // EDGES_PER_TASK
        current = current.coalesce(tasks)
        if not moving:
            break
        starred = _large_star(current, tasks).distinct().coalesce(tasks)
        current = cut_lineage(_small_star(starred, tasks).distinct().coalesce(tasks))
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).coalesce(tasks)
