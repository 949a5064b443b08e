"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.llm.shared import forget, written


def _follow(parent: DataFrame) -> DataFrame:
    """(v, p) with every parent replaced by its own."""
    return parent.join(parent.select(F.col("v").alias("p"), F.col("p").alias("_up")), "p").select("v", F.col("_up").alias("p"))


def components(links: DataFrame) -> DataFrame:
    """(v, c): for every end of the links (a, b), the smallest value that it can reach.

    Each round takes every vertex's smallest neighbour as parent, follows parents four steps, and merges vertices into where that leads,
    until no link is left between what remains. A link from a vertex to its parent becomes one between the places both lead to, so merging
    before the root is reached loses no connection. Minima are taken before the shuffle, so a vertex with very many links does not weigh on one task.
    """
    left = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    labels = links.select(F.col("a").alias("v")).union(links.select("b")).distinct().select("v", F.col("v").alias("c"))
    while not left.isEmpty():
        ends = left.union(left.select("b", "a"))
        parent = written(ends.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).select("v", F.least("v", "p").alias("p")), "parents")
        root = written(_follow(_follow(parent)), "roots")
        before, labels = labels, written(labels.join(root.withColumnRenamed("v", "c"), "c", "left").select("v", F.coalesce("p", "c").alias("c")), "labels")
        a, b = root.select(F.col("v").alias("a"), F.col("p").alias("ra")), root.select(F.col("v").alias("b"), F.col("p").alias("rb"))
        rest = left.join(a, "a").join(b, "b").where("ra <> rb")
        rest = written(rest.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        forget(left, parent, root, before)
        left = rest
    forget(left)
    return labels
