"""Connected components as a loop of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskweave.shared import written


def _through(table: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """``table`` with ``column`` replaced by its parent, where it has one."""
    step = parent.select(F.col("child").alias("_child"), F.col("parent").alias("_parent"))
    return table.join(step, table[column] == step["_child"], "left").withColumn(column, F.coalesce("_parent", column)).drop("_child", "_parent")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of ``edges``; a component is named by its smallest node.

    Each round hooks every node on its smallest neighbour, shortens the chains, and contracts the edges. A node that is not a local
    minimum goes, so at most half of the nodes are left after each round. Edges with a null end are dropped.
    """
    pairs = edges.select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    nodes = pairs.select(F.explode(F.array("child", "parent")).alias("node")).distinct()
    labels = nodes.withColumn("component", F.col("node"))
    left = written(pairs.where("child <> parent").distinct(), "edges")
    while left.limit(1).count():
        parent = left.groupBy("child").agg(F.min("parent").alias("parent"))
        for _ in range(2):
            parent = _through(parent, "parent", parent)
        parent = written(parent, "parents")
        labels = written(_through(labels, "component", parent), "labels")
        moved = _through(_through(left, "child", parent), "parent", parent)
        left = written(moved.select(F.greatest("child", "parent").alias("child"), F.least("child", "parent").alias("parent")).where("child <> parent").distinct(), "edges")
    return labels
