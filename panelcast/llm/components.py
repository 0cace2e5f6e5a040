"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.session import cut_lineage

JUMPS = 3


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of `edges` (a, b: two numbers): the smallest node that links reach.

    Each round hooks every node to its smallest neighbour if that is smaller, follows those pointers a few steps
    and contracts the edges; what is left are the edges between different groups. Self-loops and repeated
    edges do no harm. No edges, no rows."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both.where("a <> b").distinct())
    labels = cut_lineage(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")))
    while not both.isEmpty():
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        up = cut_lineage(up.select("node", F.least("node", "to").alias("to")))
        for _ in range(JUMPS):
            next_ = up.select(F.col("node").alias("to"), F.col("to").alias("further"))
            up = cut_lineage(up.join(next_, "to").select("node", F.col("further").alias("to")))
        a = up.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        b = up.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        moved = both.join(a, "a").join(b, "b").where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        l = up.select(F.col("node").alias("label"), F.col("to").alias("to"))  # noqa: E741
        labels = cut_lineage(labels.join(l, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        both = cut_lineage(moved.distinct())
    return labels
