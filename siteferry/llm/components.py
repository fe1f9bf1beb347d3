"""Connected components of a graph of any size, by joins and aggregates alone.

Large-star and small-star steps alternate until nothing changes. No neighbour list is ever gathered: a step is one
minimum per node, combined before its shuffle, and one join, so a node with very many edges costs no task more
than its share once the skewed side of the join is split. Each round is written to the shared folder, which cuts
the lineage and lets a lost executor be replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteferry.session import cut_lineage


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Rows (node, component) for every node that has an edge to another; component is the smallest node reachable.

    Edges with a null end and edges from a node to itself link nothing. Direction, order and repeats do not matter.
    No edges give no rows.
    """
    ends = edges.select(F.col(left).alias("_x"), F.col(right).alias("_y"))
    pairs = ends.filter("_x <> _y").select(F.greatest("_x", "_y").alias("u"), F.least("_x", "_y").alias("v"))
    current = cut_lineage(pairs.distinct())
    seen = _mark(current)
    while seen[0]:
        following = cut_lineage(_small_star(_large_star(current)))
        mark = _mark(following)
        current, same, seen = following, mark == seen, mark
        if same:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _mark(pairs: DataFrame) -> tuple:
    """The number of pairs and two sums over their hashes: equal marks mean that a round changed nothing."""
    hashed = F.xxhash64("u", "v")
    row = pairs.agg(F.count(F.lit(1)), F.bit_xor(hashed), F.sum(hashed.cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(pairs: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest among the node and its neighbours."""
    smallest = pairs.groupBy("u").agg(F.min("v").alias("m"))
    # As seen from the smaller end, the neighbours are all the larger ends, and perhaps smaller ones of its own.
    moved = pairs.select(F.col("v").alias("u"), F.col("u").alias("w")).join(smallest, "u", "left")
    return moved.select(F.col("w").alias("u"), F.coalesce("m", "u").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    smallest = pairs.groupBy("u").agg(F.min("v").alias("m"))
    joined = pairs.join(smallest, "u")
    moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()
