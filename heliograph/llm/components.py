"""Connected components of a graph given as links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import written


def _with_least(rows: DataFrame, node: str) -> DataFrame:
    """Rows (u, v) with `m`, the smallest of u and its neighbours v.

    A minimum combines before its shuffle, and its key is made anew after it (bits turned over), so
    that the join is between two plain shuffles and Spark can split the rows of a node with many links.
    """
    least = rows.groupBy(node).agg(F.min("v").alias("m"))
    least = least.select(F.bitwise_not(F.col(node)).alias("_k"), F.least("m", node).alias("m"))
    return rows.withColumn("_k", F.bitwise_not(F.col(node))).join(least, "_k").drop("_k")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to its smallest neighbour instead."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = _with_least(both, "u").filter("v > u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _with_least(down, "u")
    moved = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame, name: str = "links", most_rounds: int = 60) -> DataFrame:
    """Pairs (node, root) for every node of `edges` (u, v) that is not its component's smallest node.

    Each round is written to the shared folder; only its row count and checksum come to the driver.
    Rounds end when the links no longer change: then each node is linked to its root alone.
    """
    current = written(edges.filter("u <> v").select("u", "v").distinct(), name)
    seen = None
    for _ in range(most_rounds):
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        current = written(_small_star(_large_star(current)), name)
    raise RuntimeError(f"links did not settle in {most_rounds} rounds")
