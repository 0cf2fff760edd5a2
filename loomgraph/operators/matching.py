"""Matching: which candidate pairs merge. Assignments are (node_id, super_id), super_id the smallest id of the cluster."""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import settled
from ..graph import ranked


def _ends(pairs: DataFrame) -> DataFrame:
    a = pairs.select(F.col("i").alias("n"), F.col("j").alias("other"), "i", "j", "cost")
    return a.unionByName(pairs.select(F.col("j").alias("n"), F.col("i").alias("other"), "i", "j", "cost"))


def mutual_best(pairs: DataFrame, most: int | None = None, settle=settled) -> DataFrame:
    """Pairs that are each other's best by (cost, neighbour), the cheapest `most` of them.

    The best is an aggregate of structs, so hubs are combined before the shuffle."""
    best = _ends(pairs).groupBy("n").agg(F.min(F.struct("cost", "other")).alias("b")).select("n", "b.other", "b.cost")
    back = best.select(F.col("n").alias("other"), F.col("other").alias("n"))
    out = best.join(back, ["n", "other"]).where("n < other").select(F.col("n").alias("i"), F.col("other").alias("j"), "cost")
    return cheapest(out, most, settle) if most is not None else out


def greedy(pairs: DataFrame, settle=settled) -> DataFrame:
    """The matching of a scan in order of (cost, i, j), by rounds: a pair that comes first at both ends is taken. Exact for any
    strict order; a long chain of equal costs takes as many rounds as it is long."""
    left, taken = settle(pairs.select("i", "j", "cost")), None
    while not left.isEmpty():
        first = _ends(left).groupBy("n").agg(F.min(F.struct("cost", "i", "j")).alias("m")).select("n", "m.i", "m.j", "m.cost")
        won = settle(first.groupBy("i", "j", "cost").count().where("count = 2").select("i", "j", "cost"))
        taken = won if taken is None else taken.unionByName(won)
        used = won.select(F.explode(F.array("i", "j")).alias("u")).distinct()
        left = settle(left.join(used.withColumnRenamed("u", "i"), "i", "left_anti").join(used.withColumnRenamed("u", "j"), "j", "left_anti").select("i", "j", "cost"))
    return taken if taken is not None else left


def greedy_grouped(pairs: DataFrame, group: list[str]) -> DataFrame:
    """The same matching by a scan of each group; pairs of different groups never share a node."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set[int] = set()
        order = pdf.sort_values(["cost", "i", "j"])
        keep = []
        for i, j, cost in zip(order.i.tolist(), order.j.tolist(), order.cost.tolist(), strict=True):
            if i not in used and j not in used:
                used |= {i, j}
                keep.append((i, j, cost))
        return pd.DataFrame(keep, columns=["i", "j", "cost"])

    return pairs.groupBy(*group).applyInPandas(scan, "i long, j long, cost double")


def greedy_cluster(pairs: DataFrame, group: list[str], most_size: int = 4, most_merges: int | None = None, protected_size: int = 2, settle=settled) -> DataFrame:
    """Accepted merges of a union-find scan in order of (cost, i, j) with clusters of at most most_size; exact for each group.
    The cheapest most_merges of all groups are kept.

    Columns guard_i and guard_j, if there, mark protected ends: a cluster with one has at most protected_size nodes. label_i and
    label_j, if there, block a pair of two different known labels."""
    guarded, labelled = "guard_i" in pairs.columns, "label_i" in pairs.columns
    if labelled:
        pairs = pairs.where(~((F.col("label_i") >= 0) & (F.col("label_j") >= 0) & (F.col("label_i") != F.col("label_j"))))

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.sort_values(["cost", "i", "j"], ignore_index=True)
        # nodes by their places in the order of ids, as numbers of four bytes: a group can have many millions of pairs
        ids, at = np.unique(np.concatenate([order.i.to_numpy(), order.j.to_numpy()]), return_inverse=True)
        first, second = np.split(at.astype(np.int32), 2)
        del at
        up, size = array("i", range(len(ids))), array("i", [1]) * len(ids)
        safe, keep = bytearray(len(ids)), bytearray(len(order))
        if guarded:
            for at, mark in ((first, order.guard_i), (second, order.guard_j)):
                for x in np.unique(at[mark.to_numpy(dtype=bool)]).tolist():
                    safe[x] = 1

        def root(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for k, (i, j) in enumerate(zip(memoryview(first), memoryview(second), strict=True)):
            a, b = root(i), root(j)
            whole = size[a] + size[b]
            if a != b and whole <= (protected_size if safe[a] or safe[b] else most_size):
                low, high = min(a, b), max(a, b)
                up[high] = low
                size[low] = whole
                safe[low] |= safe[high]
                keep[k] = 1
        return order.loc[np.frombuffer(keep, dtype=bool), ["i", "j", "cost"]]

    guards = ["guard_i", "guard_j"] if guarded else []
    # a group's pairs are in memory: no column goes there that the scan does not read
    out = pairs.select(*group, "i", "j", "cost", *guards).groupBy(*group).applyInPandas(scan, "i long, j long, cost double")
    return cheapest(out, most_merges, settle) if most_merges is not None else out


def cheapest(pairs: DataFrame, most: int, settle=settled) -> DataFrame:
    """The `most` pairs that come first by (cost, i, j). Where there are fewer they stay as they are; else ranks are taken in ranges of
    the cost, and no task sorts all of them."""
    pairs = settle(pairs)
    if pairs.count() <= most:
        return pairs
    placed = ranked(pairs.withColumn("__all", F.lit(0)), ["__all"], ["cost", "i", "j"])
    return placed.where(F.col("rank") <= most).select(pairs.columns)


def clusters(merges: DataFrame, nodes: DataFrame, rounds: int, settle=settled) -> DataFrame:
    """(node_id, super_id): clusters of merges of diameter up to `rounds`, every other node alone."""
    label = nodes.select("node_id", F.col("node_id").alias("super_id"))
    both = merges.select(F.col("i").alias("node_id"), F.col("j").alias("to")).unionByName(merges.select(F.col("j").alias("node_id"), F.col("i").alias("to")))
    for _ in range(rounds):
        near = both.join(label.select(F.col("node_id").alias("to"), F.col("super_id").alias("s")), "to").groupBy("node_id").agg(F.min("s").alias("s"))
        label = settle(label.join(near, "node_id", "left").select("node_id", F.least("super_id", F.coalesce("s", "super_id")).alias("super_id")))
    return label


def from_matching(matched: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, super_id) of a matching: a pair's nodes get the smaller id."""
    return nodes.select("node_id").join(matched.select(F.col("j").alias("node_id"), F.col("i").alias("super_id")), "node_id", "left").select("node_id", F.coalesce("super_id", "node_id").alias("super_id"))


def level_budget(n: int, target: int, per_level: float = 0.55) -> int:
    """How many merges a level may make."""
    import math

    return max(0, n - max(target, math.ceil(n * max(per_level, target / max(n, 1)))))


def target_preserving(assignment: DataFrame, nodes: DataFrame, target_type: int) -> DataFrame:
    """Nodes of the target type alone; the others by (type, cluster)."""
    rows = assignment.join(nodes.select("node_id", "type_id"), "node_id")
    least = rows.where(F.col("type_id") != target_type).groupBy("type_id", "super_id").agg(F.min("node_id").alias("m"))
    out = rows.join(least, ["type_id", "super_id"], "left")
    return out.select("node_id", F.when(F.col("type_id") == target_type, F.col("node_id")).otherwise(F.col("m")).alias("super_id"))


def paired_by(nodes: DataFrame, key: str) -> DataFrame:
    """Baselines: nodes of a type and partition paired off in the order of `key` (a number, ties by id)."""
    placed = ranked(nodes.select("node_id", "type_id", "part_id", key), ["type_id", "part_id"], [key, "node_id"]).withColumn("g", F.floor((F.col("rank") - 1) / 2))
    out = placed.groupBy("type_id", "part_id", "g").agg(F.min("node_id").alias("i"), F.max("node_id").alias("j")).where("i != j")
    return out.select("i", "j")


def typed_hash_clusters(buckets: DataFrame, most_size: int = 4) -> DataFrame:
    """Buckets chopped in the order of ids into clusters of most_size."""
    placed = ranked(buckets, ["bucket"], "node_id", 4).withColumn("g", F.floor((F.col("rank") - 1) / most_size))
    first = placed.groupBy("bucket", "g").agg(F.min("node_id").alias("super_id"))
    return placed.join(first, ["bucket", "g"]).select("node_id", "super_id")


def quota_matching(pairs: DataFrame, limit: int, bucket_share: float = 0.0, most_share: dict[str, float] | None = None, settle=settled) -> DataFrame:
    """A matching (i, j, cost, source) of at most `limit` pairs under shares of sources: first the cheapest bucket pairs up to
    ceil(limit bucket_share), then the cheapest of all sources, a source with a largest share up to floor(limit share), then
    without bounds. Within each pass pairs go in the order of (cost, i, j) and a node is used once.

    Each pass is a greedy matching by rounds on what is left; a bound on a source cuts the pass's matching of that source to its
    cheapest, and what the cut sets free goes to the next pass."""
    taken = None
    left = settle(pairs.select("i", "j", "cost", "source"))

    def used_up(df, won):
        used = won.select(F.explode(F.array("i", "j")).alias("u")).distinct()
        return settle(df.join(used.withColumnRenamed("u", "i"), "i", "left_anti").join(used.withColumnRenamed("u", "j"), "j", "left_anti").select("i", "j", "cost", "source"))

    def one_pass(df, room, bounds):
        won = greedy(df.select("i", "j", "cost"), settle).join(df, ["i", "j", "cost"]).select("i", "j", "cost", "source")
        parts = won.where(~F.col("source").isin(list(bounds))) if bounds else won
        for s, most in bounds.items():
            parts = parts.unionByName(won.where(F.col("source") == s).orderBy("cost", "i", "j").limit(max(0, most)))
        return settle(parts.orderBy("cost", "i", "j").limit(room))

    need = -int(-(limit * bucket_share - 1e-12) // 1)
    bounds = {s: int(limit * x + 1e-12) for s, x in (most_share or {}).items()}
    passes = ([(left.where("source = 'bucket'"), need, {})] if need else []) + [(None, None, bounds), (None, None, {})]
    done = 0
    for df, room, most in passes:
        room = min(limit - done, room if room is not None else limit)
        if room <= 0:
            continue
        counts = {r.source: r.n for r in taken.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()} if taken is not None else {}
        won = one_pass(left if df is None else df, room, {s: b - counts.get(s, 0) for s, b in most.items()})
        taken = won if taken is None else taken.unionByName(won)
        left = used_up(left, won)
        done += won.count()
    return taken if taken is not None else left.where("false")


def source_distribution(pairs: DataFrame) -> DataFrame:
    """(source, n, share) of matched pairs."""
    n = pairs.agg(F.count(F.lit(1)).alias("__n"))
    return pairs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(n)).select("source", "n", (F.col("n") / F.col("__n")).alias("share"))


def repair_clusters(assignment: DataFrame, sketch: DataFrame, nodes: DataFrame, profiles: DataFrame | None = None, objective: str = "energy", quantile: float = 0.75) -> DataFrame:
    """(node_id, super_id, repaired): clusters of more than two whose spread is positive and at or above the quantile of such
    clusters are split into pairs, in the order of the first column of the sketch, the distance to the cluster's mean and the
    id; the whole is kept only where the mean spread over clusters of two and more falls, else the assignment comes back.
    objective: energy (spread of the sketch), relation (variance of profiles, dense rows) or task (entropy of labels)."""
    from .linalg import columns, row_sum

    x = profiles if objective == "relation" and profiles is not None else sketch
    names = columns(x)

    def measures(a):
        if objective == "task":
            rows = a.join(nodes.select("node_id", "label"), "node_id")
            size = rows.groupBy("super_id").agg(F.count(F.lit(1)).alias("size"))
            counts = rows.where("label >= 0").groupBy("super_id", "label").agg(F.count(F.lit(1)).alias("c"))
            total = counts.groupBy("super_id").agg(F.sum("c").alias("t"))
            p = F.col("c") / F.col("t")
            return size.join(counts.join(total, "super_id").groupBy("super_id").agg(F.sum(-p * F.log(p)).alias("m")), "super_id", "left").na.fill(0.0, ["m"])
        rows = a.join(x, "node_id").groupBy("super_id").agg(F.count(F.lit(1)).alias("size"), *[F.var_pop(c).alias(c) for c in names])
        return rows.select("super_id", "size", (row_sum([F.col(c) for c in names]) / (len(names) if objective == "relation" else 1)).alias("m"))

    before = measures(assignment)
    cut = before.where("size > 2").agg(F.percentile(F.round("m", 9), F.lit(quantile)).alias("__q"))
    bad = before.join(F.broadcast(cut)).where((F.col("size") > 2) & (F.col("m") > 0) & (F.round("m", 9) >= F.col("__q"))).select("super_id")
    rows = assignment.join(bad, "super_id", "left_semi").join(x, "node_id")
    centre = rows.groupBy("super_id").agg(*[F.avg(c).alias(f"m{c}") for c in names])
    far = row_sum([(F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in names])
    # clusters are of bounded size
    place = F.row_number().over(W.partitionBy("super_id").orderBy(F.round(names[0], 9), F.round("far", 9), "node_id"))
    halves = rows.join(centre, "super_id").withColumn("far", far).withColumn("g", F.floor((place - 1) / 2))
    first = halves.groupBy("super_id", "g").agg(F.min("node_id").alias("s"))
    split = halves.join(first, ["super_id", "g"]).select("node_id", F.col("s").alias("super_id"))
    after = assignment.join(bad, "super_id", "left_anti").select("node_id", "super_id").unionByName(split)
    mean = lambda m: m.where("size > 1").agg(F.avg("m")).first()[0] or 0.0
    better = mean(measures(after)) < mean(before)
    return (after if better else assignment.select("node_id", "super_id")).withColumn("repaired", F.lit(better))


def budgeted_hash_clusters(buckets: DataFrame, merges: int, most_size: int = 4) -> DataFrame:
    """typed_hash_clusters with at most `merges` merges: chunks of buckets, in the order of their keys, until they run out; the chunk
    at the bound is cut to the merges that are left."""
    from .selection import running

    placed = ranked(buckets.select("node_id", "bucket"), ["bucket"], "node_id", 4).withColumn("g", F.floor((F.col("rank") - 1) / most_size))
    chunks = placed.groupBy("bucket", "g").agg(F.min("node_id").alias("super_id"), (F.count(F.lit(1)) - 1).alias("size")).withColumn("key", -F.col("bucket").cast("double"))
    ahead = running(chunks, [F.col("g")], "key", "size")
    rows = placed.join(ahead.select("bucket", "g", "super_id", "before"), ["bucket", "g"])
    nth = (F.col("rank") - 1) % most_size
    keep = (nth == 0) | (F.col("before") + nth <= merges)
    return rows.select("node_id", F.when(keep, F.col("super_id")).otherwise(F.col("node_id")).alias("super_id"))


def label_conflicts(merges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Merges of two different known labels."""
    a = nodes.select(F.col("node_id").alias("i"), F.col("label").alias("li"))
    b = nodes.select(F.col("node_id").alias("j"), F.col("label").alias("lj"))
    return merges.join(a, "i").join(b, "j").where("li >= 0 AND lj >= 0 AND li != lj").select(merges.columns)


def terminal_flags(edges: DataFrame, nodes: DataFrame, hub: float = 0.99, rare: float = 0.05) -> DataFrame:
    """(node_id, protected): hubs by degree percentile and nodes on relations with few edges."""
    ends = edges.select("rel_id", F.col("src").alias("node_id")).unionByName(edges.select("rel_id", F.col("dst").alias("node_id")))
    deg = ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("deg"))
    limit = deg.agg(F.percentile("deg", F.lit(hub)).alias("cut"))
    counts = edges.groupBy("rel_id").count()
    few = counts.join(F.broadcast(counts.agg(F.sum("count").alias("t")))).where(F.col("count") < rare * F.col("t")).select("rel_id")
    rare_nodes = ends.join(F.broadcast(few), "rel_id", "left_semi").select("node_id").distinct().withColumn("r", F.lit(True))
    out = nodes.select("node_id").join(deg, "node_id", "left").join(F.broadcast(limit)).join(rare_nodes, "node_id", "left")
    return out.select("node_id", (F.coalesce(F.col("deg") > F.col("cut"), F.lit(False)) | F.coalesce("r", F.lit(False))).alias("protected"))
