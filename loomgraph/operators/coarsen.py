"""Coarse graphs: edges, features and labels under an assignment (node_id, super_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import HeteroGraph
from .linalg import incident_mass, pagerank


def coarse_edges(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Weights summed over the ends' clusters; loops stay."""
    s = assignment.select(F.col("node_id").alias("src"), F.col("super_id").alias("s"))
    d = assignment.select(F.col("node_id").alias("dst"), F.col("super_id").alias("d"))
    return edges.join(s, "src").join(d, "dst").groupBy("rel_id", F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum("w").alias("w"))


def coarse_features(features: DataFrame, assignment: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """The weighted mean of each cluster's features (node_id, w); a cluster without weight gets the plain mean."""
    rows = features.join(assignment, "node_id")
    rows = rows.join(weights.select("node_id", "w"), "node_id", "left").na.fill(0.0, ["w"]) if weights is not None else rows.withColumn("w", F.lit(1.0))
    long = rows.select("super_id", "type_id", "w", F.posexplode("x").alias("j", "v"))
    mean = F.when(F.sum("w") > 0, F.sum(F.col("w") * F.col("v")) / F.sum("w")).otherwise(F.avg("v"))
    flat = long.groupBy("super_id", "type_id", "j").agg(mean.alias("v"))
    packed = flat.groupBy("super_id", "type_id").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("s"))
    return packed.select(F.col("super_id").alias("node_id"), "type_id", F.transform("s", lambda e: e["v"]).alias("x"))


def feature_weights(graph: HeteroGraph, how: str | DataFrame) -> DataFrame | None:
    """(node_id, w): the weight at a node (degree), its PageRank, or the caller's own table; none for a plain mean."""
    if isinstance(how, DataFrame):
        return how.select("node_id", "w")
    if how == "degree":
        return incident_mass(graph.edges).withColumnRenamed("mass", "w")
    if how == "pagerank":
        return pagerank(graph.nodes, graph.edges).withColumnRenamed("rank", "w")
    return None


def coarse_labels(nodes: DataFrame, assignment: DataFrame) -> DataFrame:
    """(super_id, label): the most frequent label of a cluster, the smallest of those that tie; -1 without any."""
    rows = nodes.join(assignment, "node_id")
    counts = rows.where("label >= 0").groupBy("super_id", "label").count()
    best = counts.groupBy("super_id").agg(F.max(F.struct("count", (-F.col("label")).alias("least"))).alias("m")).select("super_id", (-F.col("m.least")).alias("label"))
    return rows.select("super_id").distinct().join(best, "super_id", "left").select("super_id", F.coalesce("label", F.lit(-1)).cast("int").alias("label"))


def coarse_graph(graph: HeteroGraph, assignment: DataFrame, how: str | DataFrame = "mean") -> HeteroGraph:
    """The graph of clusters: edges, features weighted as `how` says, majority labels, and each cluster's type and partition, which
    are those of all its nodes (the least where an assignment mixes them)."""
    kinds = graph.nodes.join(assignment, "node_id").groupBy("super_id").agg(F.min("type_id").alias("type_id"), F.min("part_id").alias("part_id"))
    nodes = kinds.join(coarse_labels(graph.nodes, assignment), "super_id").select(F.col("super_id").alias("node_id"), "type_id", "label", "part_id")
    return HeteroGraph(nodes, coarse_edges(graph.edges, assignment), graph.relations, coarse_features(graph.features, assignment, feature_weights(graph, how)))


def compose(first: DataFrame, then: DataFrame) -> DataFrame:
    """The assignment of two levels, one after the other."""
    on = then.select(F.col("node_id").alias("super_id"), F.col("super_id").alias("top"))
    return first.join(on, "super_id").select("node_id", F.col("top").alias("super_id"))


def weight_preservation(edges: DataFrame, coarse: DataFrame) -> DataFrame:
    """(rel_id, before, after, error)."""
    a = edges.groupBy("rel_id").agg(F.sum("w").alias("before"))
    b = coarse.groupBy("rel_id").agg(F.sum("w").alias("after"))
    return a.join(b, "rel_id", "full").na.fill(0.0).withColumn("error", F.abs(F.col("before") - F.col("after")))
