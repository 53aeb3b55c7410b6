"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import saved


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """Relink the neighbours of each node to the least of them.

    Large star (``both``): a node's larger neighbours. Small star: the node and its smaller
    neighbours. The least is found by a partial aggregation and joined back, so a node of any degree
    is spread over tasks.
    """
    if both:
        seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        seen = edges
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = seen.join(least, "a")
    if both:
        return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    low = linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return low.unionByName(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge, root the least node of its component.

    Nodes are of one sortable type; loops, repeated and reversed edges and null ends are allowed
    (edges with a null end link nothing). The rounds grow with the logarithm of the longest chain,
    and each is written to the shared folder.
    """
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b")))
    edges = saved(edges.distinct())
    state = None
    while True:
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if new == state or not new[0]:
            break
        state = new
        edges = saved(_stars(_stars(edges, both=True), both=False))
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
