"""Connected components of a graph held as a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each linked node reaches.

    Every round maps each node to its smallest neighbour (or itself), rewrites the links
    between the images and drops loops and repeats. The smallest node of a component maps
    to itself in every round, so it is the last one left. A star of any size takes one
    round, a chain of n nodes about log n. A node's neighbours are reduced by a partial
    minimum before the shuffle, so no task holds the links of a hot node. Null ends are
    left out.
    """
    edges = cut_lineage(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    steps = []
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        step = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("next"))
        steps.append(cut_lineage(step, "step"))
        left = steps[-1].withColumnRenamed("next", "nu")
        right = steps[-1].select(F.col("u").alias("v"), F.col("next").alias("nv"))
        edges = edges.join(left, "u").join(right, "v").select(
            F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v")).where("u <> v").distinct()
        edges = cut_lineage(edges, "edges")
    if not steps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    labels = steps[0].select(F.col("u").alias("node"), F.col("next").alias("root"))
    for step in steps[1:]:
        moved = step.select(F.col("u").alias("root"), "next")
        labels = labels.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return cut_lineage(labels, "labels")
