"""Structural, spectral and path metrics of a graph and its coarse version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import EPS, xlogx_ratio
from .linalg import columns, row_sum


def _ends(edges: DataFrame, x: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Edges with the rows of both ends, and the differences of their columns."""
    names = columns(x)
    a = x.select(F.col("node_id").alias("src"), *[F.col(c).alias(f"a{c}") for c in names])
    b = x.select(F.col("node_id").alias("dst"), *[F.col(c).alias(f"b{c}") for c in names])
    return edges.join(a, "src").join(b, "dst"), [F.col(f"a{c}") - F.col(f"b{c}") for c in names]


def dirichlet_energy(edges: DataFrame, x: DataFrame) -> DataFrame:
    """(rel_id, energy): the sum of w times the squared difference of x over each relation's edges."""
    both, diffs = _ends(edges, x)
    return both.groupBy("rel_id").agg(F.sum(F.col("w") * row_sum([d * d for d in diffs])).alias("energy"))


def dirichlet_energies(edges: DataFrame, x: DataFrame, signals: dict[str, list[str]]) -> DataFrame:
    """(rel_id, and an energy for each name of signals): the dirichlet_energy of several signals, each some columns of x, in one pass."""
    every = [c for names in signals.values() for c in names]
    side = lambda end, mark: x.select(F.col("node_id").alias(end), *[F.col(c).alias(f"{mark}{c}") for c in every])
    d = lambda c: F.col(f"a{c}") - F.col(f"b{c}")
    both = edges.join(side("src", "a"), "src").join(side("dst", "b"), "dst")
    return both.groupBy("rel_id").agg(*[F.sum(F.col("w") * row_sum([d(c) * d(c) for c in names])).alias(n) for n, names in signals.items()])


def cluster_means(x: DataFrame, assignment: DataFrame) -> DataFrame:
    return x.join(assignment, "node_id").groupBy(F.col("super_id").alias("node_id")).agg(*[F.avg(c).alias(c) for c in columns(x)])


def lifted(means: DataFrame, assignment: DataFrame) -> DataFrame:
    """Rows of clusters given to their nodes."""
    return assignment.join(means.withColumnRenamed("node_id", "super_id"), "super_id").drop("super_id")


def energy_errors(edges: DataFrame, coarse: DataFrame, x: DataFrame, assignment: DataFrame) -> DataFrame:
    """(rel_id, before, after, error): relative errors of the relations' energies, coarse signals being cluster means."""
    before = dirichlet_energy(edges, x).withColumnRenamed("energy", "before")
    after = dirichlet_energy(coarse, cluster_means(x, assignment)).withColumnRenamed("energy", "after")
    out = before.join(after, "rel_id", "left").na.fill(0.0, ["after"])
    return out.withColumn("error", F.abs(F.col("after") - F.col("before")) / F.greatest(F.abs("before"), F.lit(EPS)))


def gram(x: DataFrame) -> DataFrame:
    """(j, k, g): inner products of the columns, from one aggregate."""
    names = columns(x)
    sums = x.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in names for b in names])
    entries = [F.struct(F.lit(j).alias("j"), F.lit(k).alias("k"), F.col(f"{a}_{b}").alias("g")) for j, a in enumerate(names) for k, b in enumerate(names)]
    return sums.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def gram_error(x: DataFrame, assignment: DataFrame) -> DataFrame:
    """(error): the relative Frobenius error of the Gram matrix when each row is its cluster's mean."""
    both = gram(x).join(gram(lifted(cluster_means(x, assignment), assignment)).withColumnRenamed("g", "h"), ["j", "k"])
    d = F.col("g") - F.col("h")
    return both.agg((F.sqrt(F.sum(d * d)) / F.greatest(F.sqrt(F.sum(F.col("g") * F.col("g"))), F.lit(EPS))).alias("error"))


def relation_drift(edges: DataFrame, coarse: DataFrame) -> DataFrame:
    """(l1, js): distances of the relations' shares of weight."""
    share = lambda e, n: e.groupBy("rel_id").agg(F.sum("w").alias("m")).join(F.broadcast(e.agg(F.sum("w").alias("t")))).select("rel_id", (F.col("m") / F.col("t")).alias(n))
    both = share(edges, "p").join(share(coarse, "q"), "rel_id", "full").na.fill(0.0, ["p", "q"])
    m = (F.col("p") + F.col("q")) / 2
    return both.agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("l1"), F.sum((xlogx_ratio(F.col("p"), m) + xlogx_ratio(F.col("q"), m)) / 2).alias("js"))


def edge_collapse(edges: DataFrame, coarse: DataFrame) -> DataFrame:
    """(rel_id, edges, coarse_edges, kept, loop_share): how a relation's edges fall together."""
    a = edges.groupBy("rel_id").agg(F.count(F.lit(1)).alias("edges"))
    b = coarse.groupBy("rel_id").agg(F.count(F.lit(1)).alias("coarse_edges"), (F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("loop_share"))
    return a.join(b, "rel_id").select("rel_id", "edges", "coarse_edges", (F.col("coarse_edges") / F.col("edges")).alias("kept"), "loop_share")


def cluster_sizes(assignment: DataFrame) -> DataFrame:
    """(size, n): a histogram."""
    return assignment.groupBy("super_id").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n"))


def label_entropy(nodes: DataFrame, assignment: DataFrame) -> DataFrame:
    """(mean_entropy, clusters): the natural-log entropy of labels, over clusters with a label."""
    counts = nodes.where("label >= 0").join(assignment, "node_id").groupBy("super_id", "label").count()
    total = counts.groupBy("super_id").agg(F.sum("count").alias("t"))
    p = F.col("count") / F.col("t")
    each = counts.join(total, "super_id").groupBy("super_id").agg(F.sum(-p * F.log(p)).alias("h"))
    return each.agg(F.avg("h").alias("mean_entropy"), F.count(F.lit(1)).alias("clusters"))


def cluster_spread(x: DataFrame, assignment: DataFrame) -> DataFrame:
    """(mean_spread, p95): mean squared distance to the cluster's mean, over clusters of two and more."""
    return spread_of(x, assignment).where("size > 1").agg(F.avg("spread").alias("mean_spread"), F.percentile("spread", F.lit(0.95)).alias("p95"))


def spread_of(x: DataFrame, assignment: DataFrame) -> DataFrame:
    """(super_id, size, spread): mean squared distance to the cluster's mean."""
    names = columns(x)
    rows = x.join(assignment, "node_id").groupBy("super_id").agg(F.count(F.lit(1)).alias("size"), *[F.var_pop(c).alias(c) for c in names])
    return rows.select("super_id", "size", row_sum([F.col(c) for c in names]).alias("spread"))


def compression(nodes: DataFrame, edges: DataFrame, assignment: DataFrame, coarse: DataFrame) -> DataFrame:
    """(nodes, coarse_nodes, edges, coarse_edges, node_ratio, storage_ratio, singleton_ratio)."""
    sizes = assignment.groupBy("super_id").agg(F.count(F.lit(1)).alias("c"))
    parts = [nodes.agg(F.count(F.lit(1)).alias("nodes")), sizes.agg(F.count(F.lit(1)).alias("coarse_nodes"), F.avg((F.col("c") == 1).cast("double")).alias("singleton_ratio")), edges.agg(F.count(F.lit(1)).alias("edges")), coarse.agg(F.count(F.lit(1)).alias("coarse_edges"))]
    out = parts[0].withColumn("k", F.lit(0))
    for p in parts[1:]:
        out = out.join(F.broadcast(p.withColumn("k", F.lit(0))), "k")
    return out.select("nodes", "coarse_nodes", "edges", "coarse_edges", (F.col("coarse_nodes") / F.col("nodes")).alias("node_ratio"), ((F.col("coarse_nodes") + F.col("coarse_edges")) / (F.col("nodes") + F.col("edges"))).alias("storage_ratio"), "singleton_ratio")


def continuations(edges: DataFrame, first: int, then: int) -> DataFrame:
    """(mean_reach, starts): how many distinct nodes two relations in a row reach from a start, on average."""
    a = edges.where(F.col("rel_id") == first).select("src", F.col("dst").alias("m")).distinct()
    b = edges.where(F.col("rel_id") == then).select(F.col("src").alias("m"), "dst").distinct()
    each = a.join(b, "m").select("src", "dst").distinct().groupBy("src").agg(F.count(F.lit(1)).alias("c"))
    return each.agg(F.avg("c").alias("mean_reach"), F.count(F.lit(1)).alias("starts"))


def path_retention(edges: DataFrame, coarse: DataFrame, assignment: DataFrame, steps: list[int]) -> DataFrame:
    """(step, paths, kept, collapsed): of distinct edges on a chain of relations, how many survive as edges between two
    clusters and how many fall into a loop."""
    s = assignment.select(F.col("node_id").alias("src"), F.col("super_id").alias("a"))
    d = assignment.select(F.col("node_id").alias("dst"), F.col("super_id").alias("b"))
    marked = edges.where(F.col("rel_id").isin(steps)).select("rel_id", "src", "dst").distinct().join(s, "src").join(d, "dst")
    has = coarse.select("rel_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).alias("h"))
    out = marked.join(has, ["rel_id", "a", "b"], "left").groupBy(F.col("rel_id").alias("step"))
    return out.agg(F.count(F.lit(1)).alias("paths"), F.sum(F.coalesce("h", F.lit(0))).cast("long").alias("kept"), F.sum((F.col("a") == F.col("b")).cast("long")).alias("collapsed"))


def reconstruction(x: DataFrame, y: DataFrame) -> DataFrame:
    """(mse, mae, corr, cosine): y against x over all entries, absent ones zero."""
    names = columns(x)
    both = x.join(y.select("node_id", *[F.col(c).alias(f"y{c}") for c in names]), "node_id", "left").na.fill(0.0, [f"y{c}" for c in names])
    entry = both.select(F.explode(F.array(*[F.struct(F.col(c).alias("v"), F.col(f"y{c}").alias("y")) for c in names])).alias("e")).select("e.*")
    d = F.col("v") - F.col("y")
    norm = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    return entry.agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.corr("v", "y").alias("corr"), (F.sum(F.col("v") * F.col("y")) / F.greatest(norm("v") * norm("y"), F.lit(EPS))).alias("cosine"))


def partition_imbalance(nodes: DataFrame) -> DataFrame:
    """(type_id, imbalance): the largest partition over the mean one."""
    return nodes.groupBy("type_id", "part_id").count().groupBy("type_id").agg((F.max("count") / F.avg("count")).alias("imbalance"))
