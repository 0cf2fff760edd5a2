"""One-row reports on a level: sizes, candidates, clusters, invariants, spectral errors and baselines."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import EPS, dropped, settled
from ..graph import HeteroGraph, ranked
from . import matching as M
from .coarsen import coarse_edges
from .linalg import columns, fused, incident_mass, lazy_smoothing, normalized, row_sum
from .metrics import cluster_means, dirichlet_energy, energy_errors, gram, spread_of


def one_row(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))
    return out


def level_report(nodes: DataFrame, edges: DataFrame, coarse: DataFrame, assignment: DataFrame, candidates: DataFrame) -> DataFrame:
    """Nodes, edges and clusters before and after, and how many candidates a node has (nodes without any count as 0)."""
    p = lambda c, q, n: F.percentile(c, F.lit(q)).alias(n)
    sizes = assignment.groupBy("super_id").agg(F.count(F.lit(1)).alias("s"))
    of_nodes = sizes.agg(F.sum("s").alias("original_nodes"), F.count(F.lit(1)).alias("coarse_nodes"), F.sum((F.col("s") == 2).cast("long")).alias("matched_pairs"), F.sum(F.col("s") - 1).alias("matched_merges"), F.sum((F.col("s") > 1).cast("long")).alias("non_singleton_clusters"), F.avg((F.col("s") == 1).cast("double")).alias("singleton_ratio"), F.max("s").alias("max_cluster_size"), F.avg("s").alias("cluster_size_mean"), p("s", 0.5, "cluster_size_p50"), p("s", 0.95, "cluster_size_p95"), p("s", 0.99, "cluster_size_p99"))
    ends = candidates.select(F.explode(F.array("i", "j")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("c"))
    each = nodes.select("node_id").join(ends, "node_id", "left").na.fill(0, ["c"])
    of_pairs = each.agg(F.sum("c").alias("candidate_total"), F.max("c").alias("candidate_max"), F.avg("c").alias("candidate_mean"), F.avg((F.col("c") > 0).cast("double")).alias("candidate_coverage"), p("c", 0.5, "candidate_p50"), p("c", 0.95, "candidate_p95"), p("c", 0.99, "candidate_p99"))
    retained = candidates.agg(F.count(F.lit(1)).alias("retained_pairs"))
    out = one_row(of_nodes, edges.agg(F.count(F.lit(1)).alias("original_edges")), coarse.agg(F.count(F.lit(1)).alias("coarse_edges")), of_pairs, retained)
    return out.withColumn("compression_ratio", F.col("coarse_nodes") / F.col("original_nodes")).withColumn("node_reduction", F.col("original_nodes") - F.col("coarse_nodes"))


def reduction_by_type(nodes: DataFrame, assignment: DataFrame) -> DataFrame:
    """(type_id, before, after, reduction)."""
    rows = nodes.select("node_id", "type_id").join(assignment, "node_id").groupBy("type_id").agg(F.count(F.lit(1)).alias("before"), F.countDistinct("super_id").alias("after"))
    return rows.withColumn("reduction", F.col("before") - F.col("after"))


def sizes_by_type(nodes: DataFrame, assignment: DataFrame) -> DataFrame:
    """(type_id, size, clusters); a cluster of several types counts for the least of them."""
    rows = nodes.select("node_id", "type_id").join(assignment, "node_id").groupBy("super_id").agg(F.min("type_id").alias("type_id"), F.count(F.lit(1)).alias("size"))
    return rows.groupBy("type_id", "size").agg(F.count(F.lit(1)).alias("clusters"))


def relation_report(edges: DataFrame, coarse: DataFrame) -> DataFrame:
    """(rel_id, edges, coarse_edges, weight, coarse_weight, weight_error)."""
    a = edges.groupBy("rel_id").agg(F.count(F.lit(1)).alias("edges"), F.sum("w").alias("weight"))
    b = coarse.groupBy("rel_id").agg(F.count(F.lit(1)).alias("coarse_edges"), F.sum("w").alias("coarse_weight"))
    out = a.join(b, "rel_id", "full").na.fill(0, ["edges", "coarse_edges"]).na.fill(0.0, ["weight", "coarse_weight"])
    return out.withColumn("weight_error", F.abs(F.col("weight") - F.col("coarse_weight")))


def cluster_quality(graph: HeteroGraph, assignment: DataFrame, sketch: DataFrame, profiles: DataFrame, conv: DataFrame, most_size: int | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Means and 95th percentiles over all clusters, those of one node counting as 0: the spread of the sketch and of the conv
    response, the mean variance of the relation profile (dense rows all three), the entropy of labels (by default all, else
    those of labels(node_id, label)); and how many clusters are bad, of several types or above most_size."""

    def spread(x, name):
        return spread_of(x, assignment).select("super_id", F.col("spread").alias(name))

    base = assignment.join(graph.nodes.select("node_id", "type_id"), "node_id").groupBy("super_id").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("type_id").alias("kinds"))
    known = (labels if labels is not None else graph.nodes.select("node_id", "label")).where("label >= 0")
    counts = known.join(assignment, "node_id").groupBy("super_id", "label").agg(F.count(F.lit(1)).alias("c"))
    total = counts.groupBy("super_id").agg(F.sum("c").alias("t"))
    share = F.col("c") / F.col("t")
    entropy = counts.join(total, "super_id").groupBy("super_id").agg(F.sum(-share * F.log(share)).alias("entropy"))
    q = len(columns(profiles))
    rows = base.join(spread(sketch, "sketch"), "super_id", "left").join(spread(profiles, "profile"), "super_id", "left").join(spread(conv, "conv"), "super_id", "left").join(entropy, "super_id", "left").na.fill(0.0, ["sketch", "profile", "conv", "entropy"])
    rows = rows.withColumn("profile", F.col("profile") / max(q, 1))
    bad = (F.col("kinds") > 1) | (F.col("size") > most_size if most_size is not None else F.lit(False))
    parts = [f.alias(f"{c}_{n}") for c in ("sketch", "profile", "conv", "entropy") for n, f in (("mean", F.avg(c)), ("p95", F.percentile(c, F.lit(0.95))))]
    return rows.agg(*parts, F.sum(bad.cast("long")).alias("bad_clusters"), F.avg(bad.cast("double")).alias("bad_share"))


def invalid_assignments(nodes: DataFrame, assignment: DataFrame, coarse_nodes: DataFrame) -> DataFrame:
    """(unmapped, repeated, unknown_cluster, type_change): nodes without a cluster or with several, clusters that the coarse graph
    lacks, and nodes of another type than their cluster."""
    maps = assignment.groupBy("node_id").agg(F.count(F.lit(1)).alias("m"), F.min("super_id").alias("super_id"))
    rows = nodes.select("node_id", "type_id").join(maps, "node_id", "left").join(coarse_nodes.select(F.col("node_id").alias("super_id"), F.col("type_id").alias("ct")), "super_id", "left")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    return rows.agg(count(F.col("m").isNull()).alias("unmapped"), count(F.col("m") > 1).alias("repeated"), count(F.col("m").isNotNull() & F.col("ct").isNull()).alias("unknown_cluster"), count(F.col("ct") != F.col("type_id")).alias("type_change"))


def relation_violations(graph: HeteroGraph) -> DataFrame:
    """(no_relation, unused_relation, dangling, src_type, dst_type): edges against the table of relations and the nodes."""
    specs = graph.relations.select("rel_id", "src_type", "dst_type")
    n = graph.nodes.select("node_id", "type_id")
    e = graph.edges.join(F.broadcast(specs), "rel_id", "left").join(n.withColumnsRenamed({"node_id": "src", "type_id": "ts"}), "src", "left").join(n.withColumnsRenamed({"node_id": "dst", "type_id": "td"}), "dst", "left")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    of_edges = e.agg(F.countDistinct(F.when(F.col("src_type").isNull(), F.col("rel_id"))).alias("no_relation"), count(F.col("ts").isNull() | F.col("td").isNull()).alias("dangling"), count(F.col("ts") != F.col("src_type")).alias("src_type"), count(F.col("td") != F.col("dst_type")).alias("dst_type"))
    unused = specs.join(graph.edges.select("rel_id").distinct(), "rel_id", "left_anti").agg(F.count(F.lit(1)).alias("unused_relation"))
    return one_row(of_edges, unused).select("no_relation", "unused_relation", "dangling", "src_type", "dst_type")


def level_invariants(graph: HeteroGraph, coarse: HeteroGraph, assignment: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """The eight counters of a level, all 0 where it is sound but for the largest error of a relation's weight."""
    sums = lambda df, name: df.select(row_sum([F.col(c) for c in df.columns]).cast("long").alias(name))
    broken = lambda g: g.violations().agg(F.sum("n").alias("n"))
    schema = broken(graph).withColumnRenamed("n", "a").join(broken(coarse).withColumnRenamed("n", "b")).select((F.col("a") + F.col("b")).alias("schema_violations"))
    weights = relation_report(graph.edges, coarse.edges).agg(F.max("weight_error").alias("weight_error"), F.sum(((F.col("edges") > 0) & (F.col("coarse_edges") == 0)).cast("long")).alias("missing_relations"))
    counts = graph.nodes.agg(F.count(F.lit(1)).alias("n")).join(coarse.nodes.agg(F.count(F.lit(1)).alias("c"))).select((F.col("c") > F.col("n")).cast("long").alias("node_count_violation"))
    relations = relation_violations(HeteroGraph(coarse.nodes, coarse.edges, coarse.relations.join(graph.edges.select("rel_id").distinct(), "rel_id", "left_semi"), coarse.features))
    return one_row(schema, sums(invalid_assignments(graph.nodes, assignment, coarse.nodes), "invalid_assignments"), sums(relations, "relation_violations"), weights, counts).withColumn("weight_violation", (F.col("weight_error") > tolerance).cast("long"))


def evenly_spaced(n: str, k: int, place: str = "rank"):
    """Whether a 1-based place is among k evenly spaced ones from the first to the last of n (all of fewer)."""
    r, m = F.col(place) - 1, F.col(n) - 1
    # place r is round(i m / (k - 1)), rounded down, for the i that comes nearest
    hit = F.floor(F.ceil(r * F.lit(k - 1) / F.greatest(m, F.lit(1))) * m / F.lit(max(k - 1, 1))) == r
    return (F.col(n) <= k) | (F.lit(k > 1) & hit) | (r == 0)


def node_sample(graph: HeteroGraph, most: int) -> HeteroGraph:
    """The graph on at most `most` nodes, evenly spaced by id within each type, of which each gets its share, at least one."""
    counts = graph.nodes.groupBy("type_id").agg(F.count(F.lit(1)).alias("n"))
    whole = graph.nodes.agg(F.count(F.lit(1)).alias("all"))
    quota = counts.join(F.broadcast(whole)).withColumn("k", F.greatest(F.lit(1), F.floor(F.lit(most) * F.col("n") / F.col("all"))))
    rows = ranked(graph.nodes, ["type_id"], "node_id").join(F.broadcast(quota.select("type_id", "n", "k")), "type_id")
    # place i (0 to k - 1) of k evenly spaced ones is floor(i (n - 1) / (k - 1))
    r, m, k = F.col("rank") - 1, F.col("n") - 1, F.col("k")
    i = F.ceil(r * (k - 1) / F.greatest(m, F.lit(1)))
    keep = (F.col("n") <= k) | F.when(k > 1, F.floor(i * m / F.greatest(k - 1, F.lit(1))) == r).otherwise(r == 0)
    return graph.induced(rows.where(keep).select("node_id"))


def edge_sample(edges: DataFrame, k: int) -> DataFrame:
    """At most k edges of each relation, evenly spaced in the order of (src, dst)."""
    counts = edges.groupBy("rel_id").agg(F.count(F.lit(1)).alias("n"))
    rows = ranked(edges, ["rel_id"], ["src", "dst"]).join(F.broadcast(counts), "rel_id")
    return rows.where(evenly_spaced("n", k)).select("rel_id", "src", "dst", "w")


def envelope(graph: HeteroGraph, k: int = 1024, keep: int = 8, stages: dict[str, float] | None = None) -> DataFrame:
    """(rel_id, edges, sampled, weight, mean, loops, sources, destinations, candidate_bytes, slowest): what a sample of each
    relation's edges shows, what `keep` candidates a node would take, and the stage that took longest."""
    sample = edge_sample(graph.edges, k).groupBy("rel_id").agg(F.count(F.lit(1)).alias("sampled"), F.sum("w").alias("weight"), F.avg("w").alias("mean"), F.sum((F.col("src") == F.col("dst")).cast("long")).alias("loops"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("destinations"))
    counts = graph.edges.groupBy("rel_id").agg(F.count(F.lit(1)).alias("edges"))
    size = graph.nodes.agg((F.count(F.lit(1)) * (keep * (8 + 4 + 2) + 4)).alias("candidate_bytes"))
    slowest = max(stages, key=lambda s: stages[s]) if stages else None
    return counts.join(sample, "rel_id").join(F.broadcast(size)).withColumn("slowest", F.lit(slowest).cast("string"))


def smoothed(edges: DataFrame, x: DataFrame, steps: int, alpha: dict[int, float], settle: Callable = settled) -> DataFrame:
    e = normalized(edges)
    for _ in range(steps):
        x = settle(lazy_smoothing(e, x, alpha))
    return x


def relative(before, after):
    return F.abs(after - before) / F.greatest(F.abs(before), F.lit(EPS))


def spectral_report(graph: HeteroGraph, coarse: DataFrame, assignment: DataFrame, x: DataFrame, alpha: dict[int, float], steps: int = 1, settle: Callable = settled) -> DataFrame:
    """(dee, fse, wfe, ree_mean, ree_max, ree_p95, sipe): relative errors of the signals' energy over all relations, of their energy
    under the fused Laplacian, of the weighted sum of relation energies, of each relation's energy, and of the Gram matrix.
    Signals are smoothed `steps` times; those of the coarse graph begin as cluster means."""
    before = settle(smoothed(graph.edges, x, steps, alpha, settle))
    after = settle(smoothed(coarse, cluster_means(x, assignment), steps, alpha, settle))
    total = sum(max(a, 0.0) for a in alpha.values()) or 1.0
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(y) for r, a in alpha.items() for y in (r, max(a, 0.0) / total)]), F.col("rel_id")), F.lit(0.0))
    a, b = dirichlet_energy(graph.edges, before).withColumnRenamed("energy", "a"), dirichlet_energy(coarse, after).withColumnRenamed("energy", "b")
    both = a.join(b, "rel_id", "full").na.fill(0.0).withColumn("r", relative(F.col("a"), F.col("b")))
    by_relation = both.agg(relative(F.sum("a"), F.sum("b")).alias("dee"), relative(F.sum(weight * F.col("a")), F.sum(weight * F.col("b"))).alias("wfe"), F.avg("r").alias("ree_mean"), F.max("r").alias("ree_max"), F.percentile("r", F.lit(0.95)).alias("ree_p95"))
    fe = fused_energy(graph.edges, before, alpha, "fa").join(fused_energy(coarse, after, alpha, "fb")).select(relative(F.col("fa"), F.col("fb")).alias("fse"))
    g = gram(before).join(gram(after).withColumnRenamed("g", "h"), ["j", "k"])
    d = F.col("g") - F.col("h")
    sipe = g.agg((F.sqrt(F.sum(d * d)) / F.greatest(F.sqrt(F.sum(F.col("g") * F.col("g"))), F.lit(EPS))).alias("sipe"))
    return one_row(by_relation, fe, sipe).select("dee", "fse", "wfe", "ree_mean", "ree_max", "ree_p95", "sipe")


def fused_energy(edges: DataFrame, x: DataFrame, alpha: dict[int, float], name: str = "energy") -> DataFrame:
    """<x, (I - S) x> of the fused operator."""
    names = columns(x)
    y = fused(normalized(edges), x, alpha).select("node_id", *[F.col(c).alias(f"y{c}") for c in names])
    rest = row_sum([F.col(c) * (F.col(c) - F.coalesce(f"y{c}", F.lit(0.0))) for c in names])
    return x.join(y, "node_id", "left").agg(F.sum(rest).alias(name))


def eigenvalues(graph: HeteroGraph, alpha: dict[int, float], most: int = 256) -> list[float]:
    """The eigenvalues of I - S on the graph's sample of at most `most` nodes, ascending: a check for small graphs, on the driver."""
    import numpy as np

    small = node_sample(graph, most)
    ids = [r.node_id for r in small.nodes.select("node_id").orderBy("node_id").limit(2 * most + 64).collect()]
    place = {n: k for k, n in enumerate(ids)}
    s = np.zeros((len(ids), len(ids)))
    for r in normalized(small.edges).groupBy("rel_id", "src", "dst").agg(F.sum("w").alias("w")).collect():
        w = 0.5 * alpha.get(r.rel_id, 0.0) * r.w
        s[place[r.src], place[r.dst]] += w
        s[place[r.dst], place[r.src]] += w
    return np.linalg.eigvalsh(np.eye(len(ids)) - s).tolist()


def baseline_pairs(graph: HeteroGraph, how: str, embedding: DataFrame | None = None, seed: int = 5) -> DataFrame:
    """(i, j): pairs of a type and partition by a hash (random), in the order of the weight at a node (degree) or of one step's
    embedding (embedding, its first column), or those that are each other's heaviest edge (heavy_edge)."""
    from ..functions import mixed

    if how == "random":
        return M.paired_by(graph.nodes.withColumn("h", mixed(F.col("node_id"), 0, seed)), "h")
    if how == "degree":
        return M.paired_by(graph.nodes.join(incident_mass(graph.edges), "node_id", "left").na.fill(0.0, ["mass"]), "mass")
    if how == "embedding":
        return M.paired_by(graph.nodes.join(embedding.select("node_id", F.round("v0", 9).alias("e")), "node_id", "left").na.fill(0.0, ["e"]), "e")
    if how == "heavy_edge":
        kinds = graph.nodes.select("node_id", "type_id", "part_id")
        a = kinds.select(F.col("node_id").alias("src"), F.col("type_id").alias("ta"), F.col("part_id").alias("pa"))
        b = kinds.select(F.col("node_id").alias("dst"), F.col("type_id").alias("tb"), F.col("part_id").alias("pb"))
        e = graph.edges.where("src != dst").join(a, "src").join(b, "dst").where("ta = tb AND pa = pb")
        w = e.groupBy(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).agg((-F.sum("w")).alias("cost"))
        return M.mutual_best(w).select("i", "j")
    raise ValueError(f"no baseline {how}")


def matched_to_ratio(graph: HeteroGraph, how: str, ratio: float, tolerance: float = 0.02, rounds: int = 8, embedding: DataFrame | None = None, settle: Callable = settled) -> DataFrame:
    """An assignment by a baseline's pairings, one after another on the coarse graph, until clusters are ratio of the nodes within
    the tolerance or pairs run out. The last pairing is cut to the merges that are still wanted."""
    n = graph.nodes.count()
    want = max(1, -int(-(n * ratio) // 1))
    out, now, left = graph.nodes.select("node_id", F.col("node_id").alias("super_id")), graph, n
    for _ in range(rounds):
        if left <= want or abs(left / n - ratio) <= tolerance:
            break
        x = embedding if embedding is None else cluster_means(embedding, out)
        pairs = settle(baseline_pairs(now, how, x).orderBy("i", "j").limit(left - want))
        made = pairs.count()
        if not made:
            break
        step = M.from_matching(pairs, now.nodes)
        out = settle(out.join(step.select(F.col("node_id").alias("super_id"), F.col("super_id").alias("top")), "super_id").select("node_id", F.col("top").alias("super_id")))
        kinds = settle(now.nodes.join(step, "node_id").groupBy("super_id").agg(F.min("type_id").alias("type_id"), F.max("label").alias("label"), F.min("part_id").alias("part_id")).withColumnRenamed("super_id", "node_id"))
        now = HeteroGraph(kinds, settle(coarse_edges(graph.edges, out)), graph.relations, graph.features)
        left -= made
    return out


def baseline_report(graph: HeteroGraph, x: DataFrame, methods: tuple[str, ...] = ("random", "degree", "heavy_edge"), embedding: DataFrame | None = None) -> DataFrame:
    """(method, ratio, energy_error_mean, energy_error_max) of one pairing by each baseline; a few rows."""
    n = graph.nodes.count()
    out = None
    for m in methods:
        a = M.from_matching(baseline_pairs(graph, m, embedding), graph.nodes)
        e = energy_errors(graph.edges, coarse_edges(graph.edges, a), x, a).agg(F.avg("error").alias("energy_error_mean"), F.max("error").alias("energy_error_max"))
        row = a.agg((F.countDistinct("super_id") / n).alias("ratio")).join(e).select(F.lit(m).alias("method"), "ratio", "energy_error_mean", "energy_error_max")
        out = row if out is None else out.unionByName(row)
    return out


def split_leaks(a: DataFrame, b: DataFrame) -> int:
    """How many nodes are in both of two splits."""
    return a.select("node_id").distinct().join(b.select("node_id").distinct(), "node_id", "left_semi").count()


def train_labels(nodes: DataFrame, assignment: DataFrame, train: DataFrame) -> DataFrame:
    """(super_id, label, labelled, entropy): majority and entropy of the training nodes' labels of each cluster; -1 without any."""
    rows = assignment.join(nodes.select("node_id", "label").join(train.select("node_id").distinct(), "node_id", "left_semi").where("label >= 0"), "node_id", "left")
    counts = rows.where("label is not null").groupBy("super_id", "label").agg(F.count(F.lit(1)).alias("c"))
    total = counts.groupBy("super_id").agg(F.sum("c").alias("labelled"))
    share = F.col("c") / F.col("labelled")
    best = counts.join(total, "super_id").groupBy("super_id").agg(F.max(F.struct("c", (-F.col("label")).alias("l"))).alias("m"), F.first("labelled").alias("labelled"), F.sum(-share * F.log(share)).alias("entropy"))
    return rows.select("super_id").distinct().join(best, "super_id", "left").select("super_id", F.coalesce(-F.col("m.l"), F.lit(-1)).cast("int").alias("label"), F.coalesce("labelled", F.lit(0)).alias("labelled"), F.coalesce("entropy", F.lit(0.0)).alias("entropy"))


def two_step_connectivity(edges: DataFrame, coarse: DataFrame, assignment: DataFrame, first: int, then: int, most: int = 512) -> DataFrame:
    """(sampled, before, after, error): over evenly spaced edges of the first relation, how many distinct nodes the second one leads
    to from their ends, and in the coarse graph from their ends' clusters."""
    seen = edge_sample(edges.where(F.col("rel_id") == first), most)
    reach = lambda e, name: e.where(F.col("rel_id") == then).groupBy("src").agg(F.countDistinct("dst").alias(name))
    rows = seen.select(F.col("dst").alias("m")).join(reach(edges, "b").withColumnRenamed("src", "m"), "m", "left")
    rows = rows.join(assignment.select(F.col("node_id").alias("m"), F.col("super_id").alias("c")), "m").join(reach(coarse, "a").withColumnRenamed("src", "c"), "c", "left").na.fill(0, ["a", "b"])
    out = rows.agg(F.count(F.lit(1)).alias("sampled"), F.avg("b").alias("before"), F.avg("a").alias("after"))
    return out.withColumn("error", relative(F.col("before"), F.col("after")))


def label_propagation(graph: HeteroGraph, assignment: DataFrame, classes: int = 3, seed: int = 0, rounds: tuple[int, ...] = (0, 1, 3, 5), settle: Callable = settled) -> DataFrame:
    """(step, accuracy): labels are the largest column of smoothed Gaussian rows; clusters' shares of them are given back to their
    nodes and smoothed, and the largest column is compared with the label after some steps."""
    from .linalg import neighbour_smoothing, probe, smoothing_ends, width
    from .metrics import lifted

    x, ends = probe(graph.nodes, classes, seed, "gaussian"), settle(smoothing_ends(graph.edges))
    for _ in range(4):
        before, x = x, settle(neighbour_smoothing(graph.edges, x, ends))
        dropped(before)
    names = width(classes)
    largest = lambda: F.array_position(F.array(*[F.round(c, 9) for c in names]), F.greatest(*[F.round(c, 9) for c in names])) - 1
    truth = settle(x.select("node_id", largest().alias("t")))
    y = lifted(cluster_means(truth.select("node_id", *[(F.col("t") == k).cast("double").alias(c) for k, c in enumerate(names)]), assignment), assignment)
    out = None
    for k in range(max(rounds) + 1):
        if k:
            y = settle(neighbour_smoothing(graph.edges, y, ends))
        if k in rounds:
            row = y.select("node_id", largest().alias("p")).join(truth, "node_id").agg(F.lit(k).alias("step"), F.avg((F.col("p") == F.col("t")).cast("double")).alias("accuracy"))
            out = row if out is None else out.unionByName(row)
    return out


class Resources:
    """Seconds of each stage and the driver's largest resident memory so far: with Resources.stage(name): ..."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    def stage(self, name: str):
        import contextlib

        @contextlib.contextmanager
        def timed():
            start = time.monotonic()
            try:
                yield
            finally:
                self.seconds[name] = self.seconds.get(name, 0.0) + time.monotonic() - start

        return timed()

    def row(self) -> dict:
        import resource

        slowest = max(self.seconds, key=lambda k: self.seconds[k], default=None)
        return {"seconds": sum(self.seconds.values()), "slowest": slowest, "stages": dict(self.seconds), "max_rss_kb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss}
