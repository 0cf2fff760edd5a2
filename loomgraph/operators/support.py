"""Task-first operators: the target type stays, the support around it is scored, selected and merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import EPS
from ..graph import ranked


def _touching(edges: DataFrame, nodes: DataFrame, target: int) -> DataFrame:
    """(rel_id, side, target_id, node_id, w): edges between a target and a node of another type."""
    kinds = nodes.select("node_id", "type_id")
    s = kinds.withColumnsRenamed({"node_id": "src", "type_id": "ts"})
    d = kinds.withColumnsRenamed({"node_id": "dst", "type_id": "td"})
    both = edges.join(s, "src").join(d, "dst")
    a = both.where((F.col("ts") == target) & (F.col("td") != target)).select("rel_id", F.lit(0).alias("side"), F.col("src").alias("target_id"), F.col("dst").alias("node_id"), "w")
    b = both.where((F.col("td") == target) & (F.col("ts") != target)).select("rel_id", F.lit(1).alias("side"), F.col("dst").alias("target_id"), F.col("src").alias("node_id"), "w")
    return a.unionByName(b)


def class_footprint(edges: DataFrame, nodes: DataFrame, target: int, train: DataFrame | None = None) -> DataFrame:
    """(node_id, label, p): each support node's share of weight by the labels of the targets next to it."""
    known = nodes.where((F.col("type_id") == target) & (F.col("label") >= 0)).select(F.col("node_id").alias("target_id"), "label")
    if train is not None:
        known = known.join(train.select(F.col("node_id").alias("target_id")), "target_id", "left_semi")
    mass = _touching(edges, nodes, target).join(known, "target_id").groupBy("node_id", "label").agg(F.sum("w").alias("m"))
    return _shares(mass)


def _shares(mass: DataFrame) -> DataFrame:
    total = mass.groupBy("node_id").agg(F.sum("m").alias("t"))
    return mass.join(total, "node_id").select("node_id", "label", (F.col("m") / F.greatest("t", F.lit(EPS))).alias("p"))




def anchor_topk(edges: DataFrame, nodes: DataFrame, target: int, k: int) -> DataFrame:
    """(target_id, rel_id, node_id, w): the k heaviest support nodes of each target and relation, ties by id."""
    mass = _touching(edges, nodes, target).groupBy("target_id", "rel_id", "node_id").agg(F.sum("w").alias("w"))
    place = F.row_number().over(W.partitionBy("target_id", "rel_id").orderBy(F.desc("w"), "node_id"))
    return mass.withColumn("r", place).where(F.col("r") <= k).select("target_id", "rel_id", "node_id", "w")


def anchor_co_support(anchors: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """(i, j, score): pairs of one type and partition that share an anchor, by 1 - Jaccard of their anchors; anchors of more
    than `most` support nodes (by contract of the operator) give the pairs of the first `most` by id."""
    own = anchors.select("target_id", "node_id").distinct().join(nodes.select("node_id", "type_id", "part_id"), "node_id")
    few = own.withColumn("r", F.row_number().over(W.partitionBy("target_id", "type_id", "part_id").orderBy("node_id"))).where(F.col("r") <= most)
    key = ["target_id", "type_id", "part_id"]
    pairs = few.select(*key, F.col("node_id").alias("i")).join(few.select(*key, F.col("node_id").alias("j")), key).where("i < j")
    both = pairs.groupBy("i", "j").agg(F.count(F.lit(1)).alias("c"))
    size = own.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    out = both.join(size.withColumnsRenamed({"node_id": "i", "n": "ni"}), "i").join(size.withColumnsRenamed({"node_id": "j", "n": "nj"}), "j")
    return out.select("i", "j", (1.0 - F.col("c") / (F.col("ni") + F.col("nj") - F.col("c"))).alias("score"))





def scaled(c: str):
    """A column scaled to 0..1 over all rows, by a joined minimum and maximum: see importance."""
    lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
    return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.0)


def importance(features: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(node_id, importance): the weighted sum of min-max scaled columns."""
    ends = features.agg(*[f(c).alias(f"__{n}_{c}") for c in weights for n, f in (("lo", F.min), ("hi", F.max))])
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + w * scaled(c)
    return features.join(F.broadcast(ends)).select("node_id", total.alias("importance"))


def support_features(edges: DataFrame, nodes: DataFrame, target: int) -> DataFrame:
    """(node_id, type_id, degree, anchors, relations, purity): of each support node that touches a target."""
    touch = _touching(edges, nodes, target)
    basic = touch.groupBy("node_id").agg(F.sum("w").alias("degree"), F.countDistinct("target_id").alias("anchors"), F.countDistinct("rel_id", "side").alias("relations"))
    pure = class_footprint(edges, nodes, target).groupBy("node_id").agg(F.max("p").alias("purity"))
    return basic.join(pure, "node_id", "left").na.fill(0.0, ["purity"]).join(nodes.select("node_id", "type_id"), "node_id").select("node_id", "type_id", "degree", "anchors", "relations", "purity")


def select_top(scored: DataFrame, ratio: float, score: str = "importance") -> DataFrame:
    """(node_id): the ceil(n ratio) best, at least one, ties by id."""
    n = scored.count()
    k = max(1, -int(-(n * ratio) // 1)) if n else 0
    return scored.orderBy(F.desc(score), "node_id").limit(k).select("node_id")



def prototypes(residual: DataFrame, key: list[str], cap: int, order: str) -> DataFrame:
    """(node_id, prototype): the residual of each key in chunks of cap by (order descending, id); the least id names a chunk."""
    placed = ranked(residual, key, [order, "node_id"], descending=True).withColumn("g", F.ceil(F.col("rank") / cap))
    first = placed.groupBy(*key, "g").agg(F.min("node_id").alias("prototype"))
    return placed.join(first, [*key, "g"]).select("node_id", "prototype")


def unit_stats(units: DataFrame, edges: DataFrame, nodes: DataFrame, target: int) -> DataFrame:
    """(unit, members, mass, anchors, relations) of units (unit, node_id)."""
    touch = _touching(edges, nodes, target).join(units, "node_id").groupBy("unit").agg(F.sum("w").alias("mass"), F.countDistinct("target_id").alias("anchors"), F.countDistinct("rel_id").alias("relations"))
    size = units.groupBy("unit").agg(F.countDistinct("node_id").alias("members"))
    return size.join(touch, "unit", "left").na.fill(0, ["anchors", "relations"]).na.fill(0.0, ["mass"]).select("unit", "members", "mass", "anchors", "relations")


def storage_ratio(nodes: DataFrame, edges: DataFrame, kept: DataFrame) -> DataFrame:
    """(ratio): nodes and edges of the induced graph over all."""
    a = nodes.agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(0))
    b = edges.agg(F.count(F.lit(1)).alias("m")).withColumn("k", F.lit(0))
    ks, kd = kept.select(F.col("node_id").alias("src")), kept.select(F.col("node_id").alias("dst"))
    c = kept.agg(F.count(F.lit(1)).alias("kn")).withColumn("k", F.lit(0))
    d = edges.join(ks, "src", "left_semi").join(kd, "dst", "left_semi").agg(F.count(F.lit(1)).alias("km")).withColumn("k", F.lit(0))
    return a.join(b, "k").join(c, "k").join(d, "k").select(((F.col("kn") + F.col("km")) / (F.col("n") + F.col("m"))).alias("ratio"))
