"""Connected components by hooking and pointer jumping, in DataFrame operations over shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import drop, saved


def _jumped(parents: DataFrame, name: str) -> DataFrame:
    """parents: (node, parent), parent <= node, roots included. Follows parents to the roots."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        step = saved(parents.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), name, slim="light")
        moved = not step.where("moved").isEmpty()
        drop(parents)
        parents = step.select("node", "parent")
        parents._scoreloom_path = step._scoreloom_path
        if not moved:
            return parents


def merged(labels: DataFrame, links: DataFrame, name: str = "components") -> DataFrame:
    """labels: (node, label), label the smallest node of its component so far. links: (a, b) between nodes.

    Returns labels with the links' components joined. Every round each component hooks on to
    its smallest neighbour, so components at least halve where they still have links.
    `labels` and its result are saved tables; the one passed in is deleted when replaced.
    """
    while True:
        at_a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        at_b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        between = links.join(at_a, "a").join(at_b, "b").where("la != lb")
        hooks = saved(between.select(F.greatest("la", "lb").alias("node"), F.least("la", "lb").alias("low")).groupBy("node").agg(F.min("low").alias("low")), name, slim="light")
        if hooks.isEmpty():
            drop(hooks)
            return labels
        roots = hooks.select(F.col("low").alias("node")).distinct().join(hooks.select("node"), "node", "left_anti").withColumn("parent", F.col("node"))
        forest = _jumped(saved(hooks.select("node", F.col("low").alias("parent")).unionByName(roots), name, slim="light"), name)
        new = saved(labels.join(forest.select(F.col("node").alias("label"), "parent"), "label", "left").select("node", F.coalesce("parent", "label").alias("label")), name, slim="light")
        for old in (labels, hooks, forest):
            drop(old)
        labels = new
