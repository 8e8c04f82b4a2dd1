"""Connected components of a links table by contraction; nothing comes to the driver but whether rows are left.

Each round hooks every node to its least smaller neighbour, follows these hooks to their roots by pointer
jumping, and replaces links by links between different roots, once each; rounds end when none are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


def _between(links: DataFrame, to: DataFrame) -> DataFrame:
    """hi, lo: links (hi, lo) with both ends replaced by `to` (node, label), without loops and repeats."""
    side = lambda c: to.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
    met = links.join(side("hi"), "hi", "left").join(side("lo"), "lo", "left")
    a, b = F.coalesce("_hi", "hi"), F.coalesce("_lo", "lo")
    return met.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct()


def components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """node, label for every node of links (x, y); equal labels mean that a path of links joins two nodes.

    With start (node, label), the result of an earlier call, links are added to those that gave it.
    """
    ends = links.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    edges = links.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo"))
    if start is None:
        labels = ends.select("node", F.col("node").alias("label"))
        edges = edges.where("hi <> lo").distinct()
    else:
        labels = start.unionAll(ends.join(start, "node", "left_anti").select("node", F.col("node").alias("label")))
        edges = _between(edges, start)
    labels, edges = table(labels, "labels"), table(edges, "edges")
    while not edges.isEmpty():
        up = table(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("label")), "hooks")
        while True:
            far = up.select(F.col("node").alias("label"), F.col("label").alias("far"))
            jumped = table(up.join(far, "label", "left").select("node", F.col("label").alias("old"), F.coalesce("far", "label").alias("label")), "hooks")
            up = jumped.select("node", "label")
            if jumped.where("old <> label").isEmpty():
                break
        hooks = up.select(F.col("node").alias("label"), F.col("label").alias("root"))
        labels = table(labels.join(hooks, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        edges = table(_between(edges, up), "edges")
    return labels
