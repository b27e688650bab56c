"""Connected components of a link table, by contraction; the driver sees row counts only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _renamed(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """The links between the parents of their ends, smaller end first."""
    for end in ("a", "b"):
        to = parents.select(F.col("v").alias(end), F.col("p").alias(f"{end}_p"))
        edges = edges.join(to, end, "left").withColumn(end, F.coalesce(f"{end}_p", end)).drop(f"{end}_p")
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def components(links: DataFrame) -> DataFrame:
    """v, label for each end of the links (a, b of one type): label is the smallest v of the component.

    Each round hooks every vertex to its smallest neighbour, halves the paths twice, and goes on with the links
    between different parents, of which there are ever fewer; then the rounds' maps are applied in turn.
    """
    edges = C.stash(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = C.stash(edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().withColumn("label", F.col("v")), "labels")
    while not edges.isEmpty():
        parents = C.stash(edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p")), "parents")
        for _ in range(2):
            up = parents.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            shorter = C.stash(parents.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p")), "parents")
            C.drop(parents)
            parents = shorter
        fewer = C.stash(_renamed(edges, parents), "edges")
        moved = C.stash(labels.join(parents.select(F.col("v").alias("label"), "p"), "label", "left").select("v", F.coalesce("p", "label").alias("label")), "labels")
        C.drop(edges, labels, parents)
        edges, labels = fewer, moved
    C.drop(edges)
    return labels
