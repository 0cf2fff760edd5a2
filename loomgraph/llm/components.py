"""Connected components of a graph given as an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._exchange import settle


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): each id of an edge with the smallest id that it can reach.

    Each round points every vertex at the least of its neighbours and itself, follows the pointers to their roots by
    doubling, and contracts the edges to roots. A root that is alone in its tree has a smaller neighbour in the next round,
    so every two rounds at least halve the vertices that are left; a round follows a chain of n pointers in log2 n steps.
    Nothing but whether rows are left reaches the driver. Null ends are ignored.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna().where("u != v")
    left = settle(both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = None
    while True:
        ends = left.select(F.col("u").alias("id"), F.col("v").alias("to")).unionByName(left.select(F.col("v").alias("id"), F.col("u").alias("to")))
        step = _rooted(settle(ends.groupBy("id").agg(F.least("id", F.min("to")).alias("label"))))
        if labels is None:
            labels = step
        else:
            then = step.select(F.col("id").alias("label"), F.col("label").alias("onward"))
            labels = settle(labels.join(then, "label", "left").select("id", F.coalesce("onward", "label").alias("label")))
        u = step.select(F.col("id").alias("u"), F.col("label").alias("lu"))
        v = step.select(F.col("id").alias("v"), F.col("label").alias("lv"))
        left = settle(left.join(u, "u").join(v, "v").where("lu != lv").select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct())
        if left.isEmpty():
            return labels.withColumnRenamed("label", "component")


def _rooted(pointers: DataFrame) -> DataFrame:
    """(id, label): each id with the end of its chain of pointers; roots point at themselves."""
    while True:
        onward = pointers.where("id != label").select(F.col("id").alias("label"), F.col("label").alias("onward"))
        if pointers.where("id != label").join(onward, "label", "left_semi").isEmpty():
            return pointers
        pointers = settle(pointers.join(onward, "label", "left").select("id", F.coalesce("onward", "label").alias("label")))
