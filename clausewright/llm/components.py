"""Connected components of a graph given as an edge table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.operators.sizing import materialise


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node of an edge table can reach.

    ``edges`` has two columns of numbers, ``a`` and ``b``, in any direction; NULLs
    and loops are ignored. Returns ``id, component`` for every node that has an
    edge to another one; an empty table gives an empty result. Each round hooks
    every node onto its smallest neighbour, flattens the trees, and goes on with
    the edges between different trees, so the rounds grow with the logarithm of
    the longest chain, and nothing but a count reaches the driver.
    """
    links = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = materialise(links)
    label = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component"))
        parent = flatten(materialise(parent))
        label = parent if label is None else materialise(move(label, "component", parent))
        links = move(move(links, "a", parent), "b", parent).where("a <> b")
        links = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if label is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return label


def move(df: DataFrame, column: str, label: DataFrame) -> DataFrame:
    """Replaces the nodes in a column by their labels; nodes without one stay."""
    to = label.select(F.col("id").alias(column), F.col("component").alias("_to"))
    return df.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to").select(df.columns)


def flatten(label: DataFrame) -> DataFrame:
    """Points every node at the root of its tree. A root is a node that is its own label."""
    while True:
        up = label.select(F.col("id").alias("component"), F.col("component").alias("_up"))
        label = materialise(
            label.join(up, "component", "left")
            .withColumn("moved", F.col("_up") != F.col("component"))
            .select("id", F.coalesce("_up", "component").alias("component"), F.coalesce("moved", F.lit(False)).alias("moved"))
        )
        moved = not label.where("moved").isEmpty()
        label = label.drop("moved")
        if not moved:
            return label
