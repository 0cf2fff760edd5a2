"""Task-first terms: how the target type responds to its own labels, and what a merge of support nodes would cost it.

The target type stays as it is and its support, all other types, is merged. Labels come from `known`, the target nodes whose
labels may be seen."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import EPS, settled, xlogx_ratio
from ..graph import HeteroGraph, neighbours
from .candidates import retain
from .coarsen import coarse_edges
from .linalg import columns, lazy_smoothing, normalized, row_sum, spmm, wide, width
from .matching import clusters, greedy_cluster
from .metrics import cluster_means, lifted
from .scoring import normalize
from .sketch import row_normalize, side_by_side
from .support import anchor_co_support, anchor_topk

TIMES = (0.25, 1.0, 4.0)
LAMBDAS = {"spec": 1.0, "rel": 0.5, "cov": 0.75, "pur": 0.75, "feat": 0.1}
POLICIES = ("zero_as_no_conflict", "purity_v2", "unknown_blocks_known", "unknown_only_merge", "unknown_propagated")


def seeds(nodes: DataFrame, known: DataFrame, classes: int) -> DataFrame:
    """Dense rows of all nodes: a known node's label as a unit vector over 0..classes - 1, zero elsewhere."""
    marks = known.select("node_id", F.col("label").alias("__l"))
    rows = nodes.select("node_id").join(marks, "node_id", "left")
    return rows.select("node_id", *[F.when(F.col("__l") == k, 1.0).otherwise(0.0).alias(c) for k, c in enumerate(width(classes))])


def smoothing_steps(t: float) -> int:
    return max(2, math.ceil(2.0 * t))


def filter_bank(edges: DataFrame, seed: DataFrame, relations: list[int], times: tuple[float, ...] = TIMES, settle=settled) -> dict[float, DataFrame]:
    """For each time the seed after max(2, ceil(2 t)) smoothing steps; a longer time goes on from a shorter one."""
    e, alpha = settle(normalized(edges)), dict.fromkeys(relations, 1.0)
    out, x, done = {}, seed, 0
    for t in sorted(times):
        while done < smoothing_steps(t):
            x = settle(lazy_smoothing(e, x, alpha))
            done += 1
        out[t] = x
    return out


def _error(before: DataFrame, after: DataFrame, eps: float) -> float:
    """|before - after|^2 over |before|^2."""
    names = columns(before)
    both = before.join(after.select("node_id", *[F.col(c).alias(f"y{c}") for c in names]), "node_id", "left").na.fill(0.0, [f"y{c}" for c in names])
    d = row_sum([(F.col(c) - F.col(f"y{c}")) * (F.col(c) - F.col(f"y{c}")) for c in names])
    r = both.agg(F.sum(d).alias("d"), F.sum(row_sum([F.col(c) * F.col(c) for c in names])).alias("n")).first()
    return (r.d or 0.0) / max(r.n or 0.0, eps)


def response_error(graph: HeteroGraph, assignment: DataFrame, seed: DataFrame, target: int, relations: list[int], times: tuple[float, ...] = TIMES, eps: float = EPS, settle=settled) -> float:
    """The mean over the times of the target's relative response error in the coarse graph, whose seed is the clusters' mean."""
    targets = graph.nodes_of_type(target).select("node_id")
    before = filter_bank(graph.edges, seed, relations, times, settle)
    after = filter_bank(settle(coarse_edges(graph.edges, assignment)), cluster_means(seed, assignment), relations, times, settle)
    on = lambda x: x.join(targets, "node_id", "left_semi")
    errors = [_error(on(before[t]), on(lifted(after[t], assignment)), eps) for t in times]
    return sum(errors) / len(errors)


def relation_response(edges: DataFrame, relation, seed: DataFrame, target: int) -> DataFrame:
    """The seed there and back over one relation (rel_id, src_type, dst_type) at the target type; one step for a relation
    within it."""
    e = normalized(edges.where(F.col("rel_id") == relation.rel_id))
    steps = {(True, True): ["forward"], (True, False): ["forward", "backward"], (False, True): ["backward", "forward"]}.get((relation.src_type == target, relation.dst_type == target))
    if steps is None:
        raise ValueError("the relation does not touch the target type")
    for d in steps:
        seed = spmm(e, seed, d).drop("rel_id")
    return seed


def relation_response_errors(graph: HeteroGraph, assignment: DataFrame, seed: DataFrame, target: int, eps: float = EPS) -> dict[int, float]:
    """For each relation that touches the target type the relative error of the coarse graph's response; their mean is the
    relation response error."""
    coarse, means = coarse_edges(graph.edges, assignment), cluster_means(seed, assignment)
    targets, out = graph.nodes_of_type(target).select("node_id"), {}
    for r in graph.relations.orderBy("rel_id").collect():
        if target in (r.src_type, r.dst_type):
            before = targets.join(relation_response(graph.edges, r, seed, target), "node_id", "left").na.fill(0.0)
            after = lifted(relation_response(coarse, r, means, target), assignment)
            out[r.rel_id] = _error(before, after, eps)
    return out


def relation_footprints(edges: DataFrame, relations: DataFrame, target: int, all_relations: bool = False) -> DataFrame:
    """(node_id, dim, p): each support node's shares of weight over the relations that touch the target type and the side that
    the node is on, dim = 2 rel_id + side."""
    few = relations.select("rel_id", "src_type", "dst_type") if all_relations else relations.where((F.col("src_type") == target) | (F.col("dst_type") == target)).select("rel_id", "src_type", "dst_type")
    e = edges.join(F.broadcast(few), "rel_id")
    s = e.where(F.col("src_type") != target).groupBy(F.col("src").alias("node_id"), (2 * F.col("rel_id")).alias("dim")).agg(F.sum("w").alias("m"))
    d = e.where(F.col("dst_type") != target).groupBy(F.col("dst").alias("node_id"), (2 * F.col("rel_id") + 1).alias("dim")).agg(F.sum("w").alias("m"))
    mass = s.unionByName(d)
    total = mass.groupBy("node_id").agg(F.sum("m").alias("t"))
    return mass.join(total, "node_id").select("node_id", "dim", (F.col("m") / F.greatest("t", F.lit(EPS))).alias("p"))


def class_mass(edges: DataFrame, relations: DataFrame, target: int, known: DataFrame) -> DataFrame:
    """(node_id, label, m): the weight of each support node's edges to known targets, by their labels."""
    kinds = F.broadcast(relations.select("rel_id", "src_type", "dst_type"))
    e = edges.join(kinds, "rel_id")
    out = e.where((F.col("src_type") == target) & (F.col("dst_type") != target)).select(F.col("src").alias("t"), F.col("dst").alias("node_id"), "w")
    into = e.where((F.col("dst_type") == target) & (F.col("src_type") != target)).select(F.col("dst").alias("t"), F.col("src").alias("node_id"), "w")
    return out.unionByName(into).join(known.select(F.col("node_id").alias("t"), "label"), "t").groupBy("node_id", "label").agg(F.sum("w").alias("m"))


def propagated_mass(edges: DataFrame, relations: DataFrame, target: int, mass: DataFrame) -> DataFrame:
    """mass plus what comes back from the targets next to a support node when each target gathers the mass around it."""
    kinds = F.broadcast(relations.select("rel_id", "src_type", "dst_type"))
    e = edges.join(kinds, "rel_id")
    out = e.where((F.col("src_type") == target) & (F.col("dst_type") != target)).select(F.col("src").alias("t"), F.col("dst").alias("node_id"), "w")
    into = e.where((F.col("dst_type") == target) & (F.col("src_type") != target)).select(F.col("dst").alias("t"), F.col("src").alias("node_id"), "w")
    links = out.unionByName(into)
    context = links.join(mass, "node_id").groupBy("t", "label").agg(F.sum(F.col("w") * F.col("m")).alias("m"))
    back = links.join(context, "t").groupBy("node_id", "label").agg(F.sum(F.col("w") * F.col("m")).alias("m"))
    return mass.unionByName(back).groupBy("node_id", "label").agg(F.sum("m").alias("m"))


def class_footprints(edges: DataFrame, relations: DataFrame, target: int, known: DataFrame, mode: str = "onehop", alpha: float = 0.5) -> DataFrame:
    """(node_id, label, p): shares of mass: onehop, twohop (with what is propagated) or hybrid (onehop + alpha twohop)."""
    mass = class_mass(edges, relations, target, known)
    if mode != "onehop":
        two = propagated_mass(edges, relations, target, mass)
        mass = two if mode == "twohop" else mass.unionByName(two.withColumn("m", alpha * F.col("m"))).groupBy("node_id", "label").agg(F.sum("m").alias("m"))
    total = mass.groupBy("node_id").agg(F.sum("m").alias("t"))
    return mass.join(total, "node_id").select("node_id", "label", (F.col("m") / F.greatest("t", F.lit(EPS))).alias("p"))


def footprint_state(nodes: DataFrame, target: int, footprint: DataFrame, relation_footprint: DataFrame, anchors: DataFrame) -> DataFrame:
    """(node_id, state) of support nodes: `known` with class mass, else `connected` with relation mass or an anchor, else `weak`."""
    known = footprint.groupBy("node_id").agg(F.sum("p").alias("c"))
    rel = relation_footprint.groupBy("node_id").agg(F.sum("p").alias("r"))
    has = anchors.select("node_id").distinct().withColumn("a", F.lit(1))
    rows = nodes.where(F.col("type_id") != target).select("node_id").join(known, "node_id", "left").join(rel, "node_id", "left").join(has, "node_id", "left")
    state = F.when(F.coalesce("c", F.lit(0.0)) > EPS, "known").when((F.coalesce("r", F.lit(0.0)) > EPS) | F.col("a").isNotNull(), "connected").otherwise("weak")
    return rows.select("node_id", state.alias("state"))


def packed(table: DataFrame, dim: str, size: int) -> DataFrame:
    """(node_id, a): entries (node_id, dim, p) as arrays of doubles."""
    sums = table.groupBy("node_id").agg(*[F.sum(F.when(F.col(dim) == k, F.col("p")).otherwise(0.0)).alias(f"a{k}") for k in range(size)])
    return sums.select("node_id", F.array(*[f"a{k}" for k in range(size)]).alias("a"))


def row_distance(a: Column, b: Column, eps: float = EPS) -> Column:
    """|a - b|^2 over |a|^2 + |b|^2 of two arrays."""
    fold = lambda e: F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    size = fold(F.transform(a, lambda v: v * v)) + fold(F.transform(b, lambda v: v * v))
    return fold(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / F.greatest(size, F.lit(eps))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon, natural log, of arrays of shares; a row without mass counts as zeros."""

    def part(x, y):
        m = (x + y) / 2
        return (xlogx_ratio(x, m) + xlogx_ratio(y, m)) / 2

    return F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda s, v: s + v)


def anchor_lists(anchors: DataFrame, eps: float = EPS) -> DataFrame:
    """(node_id, keys, targets): a support node's memberships from anchors (target_id, rel_id, node_id, w): structs of the
    anchor and relation with the weight and the anchor's squared weight; and the sorted distinct anchors. Lists are as long as
    the anchors that rank a node among their few heaviest."""
    norm = anchors.groupBy("target_id", "rel_id").agg(F.greatest(F.sum(F.col("w") * F.col("w")), F.lit(eps)).alias("norm"))
    rows = anchors.join(norm, ["target_id", "rel_id"])
    member = F.struct(F.struct("target_id", "rel_id").alias("key"), "w", "norm")
    return rows.groupBy("node_id").agg(F.collect_list(member).alias("keys"), F.array_sort(F.collect_set("target_id")).alias("targets"))


@dataclass
class State:
    """What scores of pairs need: one row for each support node."""

    table: DataFrame
    classes: int


def build_state(graph: HeteroGraph, target: int, known: DataFrame, anchors: DataFrame, classes: int, signature: DataFrame | None = None, mode: str = "onehop") -> State:
    """(node_id, type_id, part_id, cls, rel, sig, state, keys, targets, x): footprints by class and by relation, the response
    signature (by default the class footprint), the footprint state, anchors and features of each support node."""
    dims = 2 * ((graph.relations.agg(F.max("rel_id")).first()[0] or 0) + 1)
    cls = class_footprints(graph.edges, graph.relations, target, known, mode)
    rel = relation_footprints(graph.edges, graph.relations, target)
    states = footprint_state(graph.nodes, target, cls, rel, anchors)
    rows = graph.nodes.where(F.col("type_id") != target).select("node_id", "type_id", "part_id").join(states, "node_id")
    rows = rows.join(packed(cls.withColumnRenamed("label", "k"), "k", classes).withColumnRenamed("a", "cls"), "node_id", "left")
    rows = rows.join(packed(rel, "dim", dims).withColumnRenamed("a", "rel"), "node_id", "left")
    rows = rows.join(anchor_lists(anchors), "node_id", "left").join(graph.features.select("node_id", "x"), "node_id", "left")
    zeros = lambda n: F.array(*[F.lit(0.0)] * n)
    rows = rows.withColumn("cls", F.coalesce("cls", zeros(classes))).withColumn("rel", F.coalesce("rel", zeros(dims)))
    rows = rows.withColumn("targets", F.coalesce("targets", F.array().cast("array<long>")))
    if signature is not None:
        rows = rows.join(signature.select("node_id", F.array(*columns(signature)).alias("sig")), "node_id", "left")
    else:
        rows = rows.withColumn("sig", F.col("cls"))
    return State(rows, classes)


def with_state(pairs: DataFrame, state: State) -> DataFrame:
    side = lambda end: state.table.select(*[F.col(c).alias(end if c == "node_id" else f"{c}_{end}") for c in state.table.columns])
    return pairs.join(side("i"), "i").join(side("j"), "j")


def purity(both: DataFrame, limit: float = 0.35, policy: str = "zero_as_no_conflict") -> Column:
    """Whether a pair may merge. Two known footprints may where their divergence is at most `limit`. Otherwise it depends:
    zero_as_no_conflict takes missing mass as zeros; purity_v2 wants both or none known, and of two unknown ones near
    relation footprints; unknown_blocks_known wants both or none known; unknown_only_merge wants none; unknown_propagated
    wants near relation footprints where just one is known."""
    if policy not in POLICIES:
        raise ValueError(f"no policy {policy}")
    near = F.round(divergence(F.col("cls_i"), F.col("cls_j")), 9) <= limit
    if policy == "zero_as_no_conflict":
        return near
    a, b = F.col("state_i") == "known", F.col("state_j") == "known"
    alike = F.round(row_distance(F.col("rel_i"), F.col("rel_j")), 9) <= limit
    rest = {
        "purity_v2": F.when(a | b, False).otherwise(alike),
        "unknown_blocks_known": ~(a | b),
        "unknown_only_merge": ~(a | b),
        "unknown_propagated": F.when(a | b, alike).otherwise(True),
    }[policy]
    return F.when(a & b, near).otherwise(rest)


def allowed(both: DataFrame, target: int, limit: float = 0.35, policy: str = "zero_as_no_conflict") -> DataFrame:
    """Pairs that may merge: two support nodes of one type and one partition whose footprints agree."""
    ok = (F.col("i") != F.col("j")) & (F.col("type_id_i") != target) & (F.col("type_id_i") == F.col("type_id_j")) & (F.col("part_id_i") == F.col("part_id_j"))
    return both.where(ok & purity(both, limit, policy))


def coverage(both: DataFrame, mode: str = "same_anchor", w_anchor: float = 1.0, w_class: float = 1.0, w_div: float = 1.0) -> Column:
    """What a merge loses of the anchors' coverage.

    same_anchor: the mean over anchors and relations that both serve of (w_i^2 + w_j^2) over the anchor's squared weights.
    class_context: the divergence of their class footprints. cross_anchor: that times the Jaccard distance of their anchors.
    combined: the sum of the three. coverage_v2: w_anchor times the Jaccard distance, w_class times the divergence and w_div
    times their product."""
    context = divergence(F.col("cls_i"), F.col("cls_j"))
    union = F.size(F.array_union("targets_i", "targets_j"))
    apart = F.when(union == 0, 0.0).otherwise(1.0 - F.size(F.array_intersect("targets_i", "targets_j")) / union)
    theirs = F.map_from_arrays(F.col("keys_j.key"), F.col("keys_j.w"))
    common = F.filter("keys_i", lambda k: F.array_contains(F.col("keys_j.key"), k["key"]))
    losses = F.transform(common, lambda k: (k["w"] * k["w"] + F.element_at(theirs, k["key"]) * F.element_at(theirs, k["key"])) / k["norm"])
    same = F.coalesce(F.when(F.size(losses) > 0, F.aggregate(losses, F.lit(0.0), lambda s, v: s + v) / F.size(losses)), F.lit(0.0))
    modes = {"same_anchor": same, "class_context": context, "cross_anchor": apart * context, "combined": same + apart * context + context, "coverage_v2": w_anchor * apart + w_class * context + w_div * apart * context}
    return modes[mode]


def purity_delta(both: DataFrame, policy: str = "zero_as_no_conflict") -> Column:
    """A quarter of the squared distance of class footprints; but for zero_as_no_conflict 1 where just one is known, and a
    quarter of the distance of relation footprints where none is."""
    square = F.aggregate(F.zip_with("cls_i", "cls_j", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v) / 4
    if policy == "zero_as_no_conflict":
        return square
    a, b = F.col("state_i") == "known", F.col("state_j") == "known"
    return F.when(a & b, square).when(a | b, 1.0).otherwise(0.25 * row_distance(F.col("rel_i"), F.col("rel_j")))


def pair_deltas(both: DataFrame, mode: str = "local_surrogate", coverage_mode: str = "same_anchor", policy: str = "zero_as_no_conflict") -> DataFrame:
    """(i, j, spec, rel, cov, pur, feat): local_surrogate takes spec from class footprints, response_signature from signatures."""
    spec = {"local_surrogate": "cls", "response_signature": "sig"}[mode]
    feat = F.coalesce(row_distance(F.col("x_i"), F.col("x_j"), 1e-8), F.lit(0.0))
    terms = {"spec": row_distance(F.col(f"{spec}_i"), F.col(f"{spec}_j"), 1e-8), "rel": row_distance(F.col("rel_i"), F.col("rel_j"), 1e-8), "cov": coverage(both, coverage_mode), "pur": purity_delta(both, policy), "feat": feat}
    return both.select("i", "j", *[e.alias(c) for c, e in terms.items()])


def task_cost(deltas: DataFrame, lambdas: dict[str, float] | None = None, normalization: str = "none") -> DataFrame:
    """deltas with cost, the weighted sum of their terms, each over its 95th percentile if asked for."""
    if normalization == "p95":
        for t in LAMBDAS:
            deltas = normalize(deltas, t, "p95")
    return deltas.withColumn("cost", row_sum([w * F.col(t) for t, w in (lambdas or LAMBDAS).items()]))


def delta_distribution(costed: DataFrame) -> DataFrame:
    """(term, p50, p95, max) of the terms and the cost."""
    each = costed.unpivot([], [*LAMBDAS, "cost"], "term", "x")
    return each.groupBy("term").agg(F.percentile("x", F.lit(0.5)).alias("p50"), F.percentile("x", F.lit(0.95)).alias("p95"), F.max("x").alias("max"))


def support_budget(nodes: int, targets: int, support_ratio: float | None = None, target_ratio: float | None = None, merges: int | None = None) -> dict:
    """How many nodes and merges: from a number of merges, or a ratio of the support, or one of all nodes, which cannot go below
    the targets; without any of them there is no bound."""
    support, infeasible, most = nodes - targets, False, None
    wanted = support
    clipped = lambda r: min(max(r, 0.0), 1.0)
    if merges is not None:
        most = max(0, min(support, merges))
        wanted = support - most
    elif support_ratio is not None:
        wanted = max(0, min(support, math.ceil(support * clipped(support_ratio) - 1e-12)))
        most = support - wanted
    elif target_ratio is not None:
        total = max(0, min(nodes, math.ceil(nodes * clipped(target_ratio) - 1e-12)))
        infeasible = total < targets
        wanted = max(0, min(support, max(targets, total) - targets))
        most = support - wanted
    total = nodes if merges is None and support_ratio is None and target_ratio is None else targets + wanted
    return {"support_nodes": support, "desired_support_nodes": wanted, "desired_total_nodes": total, "max_merges": most, "infeasible": infeasible, "floor_ratio": targets / max(nodes, 1)}


def stop_reason(current: int, desired: int, most: int | None, candidates: int, eligible: int, selected: int, last_level: bool = False) -> str:
    """Why a run stops, by the first rule that holds."""
    rules = ((current <= desired, "reached_requested_support_ratio"), (last_level, "max_levels_reached"), (most is not None and most <= 0, "merge_budget_floor"), (candidates <= 0, "candidate_exhaustion"), (eligible <= 0, "constraint_blocked_all_candidates"), (selected <= 0, "no_selected_merges"))
    return next((name for holds, name in rules if holds), "not_stopped")


def row_window(state: State, column: str, k: int, source: str) -> DataFrame:
    """Candidates (i, j, score, source): support nodes up to k places apart within a type, in the order of their rows' sums with
    weights that rise evenly from 1 to 2; the score is the distance of their rows."""
    weight = lambda v, i: v * (1.0 + i / F.greatest(F.size(column) - 1, F.lit(1)))
    key = F.round(F.aggregate(F.transform(column, weight), F.lit(0.0), lambda s, v: s + v), 9)
    rows = state.table.select("node_id", "type_id", key.alias("__key"), F.col(column).alias("row"))
    near = neighbours(rows, ["type_id"], ["__key", "node_id"], k, ["row"])
    lo, hi = F.least("i", "j"), F.greatest("i", "j")
    return near.select(lo.alias("i"), hi.alias("j"), row_distance(F.col("row_i"), F.col("row_j")).alias("score"), F.lit(source).alias("source"))


def anchor_pairs(anchors: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """Candidates of one type that share an anchor, by 1 - Jaccard of their anchors (see support.anchor_co_support)."""
    pairs = anchor_co_support(anchors, nodes, most)
    return pairs.select("i", "j", "score", F.lit("anchor").alias("source"))


def hybrid_candidates(state: State, anchors: DataFrame, nodes: DataFrame, k: int, most: int = 16) -> DataFrame:
    """Candidates by anchors, class footprints and response signatures, of each node the best 3 k."""
    return retain(anchor_pairs(anchors, nodes, most).unionByName(row_window(state, "cls", k, "footprint")).unionByName(row_window(state, "sig", k, "response")), 3 * k)


def response_signature(graph: HeteroGraph, seed: DataFrame, target: int, known: DataFrame, classes: int, times: tuple[float, ...] = TIMES, settle=settled) -> DataFrame:
    """Dense rows of norm 1: class footprint, relation footprint and the responses of the filter bank side by side."""
    relations = graph.relations.orderBy("rel_id").collect()
    dims = 2 * (max((r.rel_id for r in relations), default=0) + 1)
    cls = wide(class_footprints(graph.edges, graph.relations, target, known).select("node_id", F.col("label").alias("j"), F.col("p").alias("v")), classes)
    rel = wide(relation_footprints(graph.edges, graph.relations, target).select("node_id", F.col("dim").alias("j"), F.col("p").alias("v")), dims)
    bank = filter_bank(graph.edges, seed, [r.rel_id for r in relations], times, settle)
    return row_normalize(side_by_side(cls, rel, *[bank[t] for t in sorted(bank)]))


def task_first_level(graph: HeteroGraph, target: int, known: DataFrame, classes: int, support_ratio: float, k: int = 4, anchors: int = 3, most_size: int = 4, limit: float = 0.35, settle=settled) -> tuple[DataFrame, str]:
    """(assignment, why it stopped) of one level: hybrid candidates, what constraints allow, costs over 95th percentiles, and the
    cheapest merges of clusters within the support budget. Target nodes stay alone."""
    top = settle(anchor_topk(graph.edges, graph.nodes, target, anchors))
    state = build_state(graph, target, known, top, classes)
    state = State(settle(state.table), classes)
    nodes, targets = graph.nodes.count(), graph.nodes_of_type(target).count()
    budget = support_budget(nodes, targets, support_ratio)
    found = settle(hybrid_candidates(state, top, graph.nodes, k))
    fit = allowed(with_state(found.select("i", "j"), state), target, limit)
    # five scales read the terms of all pairs
    deltas = settle(pair_deltas(fit))
    costs = settle(task_cost(deltas, normalization="p95").withColumn("cost", F.round("cost", 9)))
    kinds = graph.nodes.select(F.col("node_id").alias("i"), "type_id", "part_id")
    merges = settle(greedy_cluster(costs.join(kinds, "i"), ["type_id", "part_id"], most_size, budget["max_merges"], settle=settle))
    done = merges.count()
    reason = stop_reason(budget["support_nodes"] - done, budget["desired_support_nodes"], budget["max_merges"], found.count(), costs.count(), done)
    return clusters(merges, graph.nodes, most_size, settle), reason


def anchor_shares(anchors: DataFrame) -> DataFrame:
    """(node_id, shares): each support node's weight to each anchor over all of it, as a map."""
    rows = anchors.groupBy("node_id", "target_id").agg(F.sum("w").alias("w"))
    whole = rows.groupBy("node_id").agg(F.sum("w").alias("t"))
    return rows.join(whole, "node_id").groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("target_id", (F.col("w") / F.greatest("t", F.lit(EPS)))))).alias("shares"))


def signature_matching(pairs: DataFrame, state: State, anchors: DataFrame, group: list[str], most_size: int = 4, merges: int | None = None, lambdas: dict[str, float] | None = None) -> DataFrame:
    """Accepted merges (i, j, cost): pairs go in the order of the cost of their two nodes' signatures (anchors, class footprints,
    responses, relation footprints, features), and each merges the clusters that its nodes are in by then, up to most_size."""
    lam = lambdas or LAMBDAS
    empty = F.create_map().cast("map<bigint,double>")
    shares = anchor_shares(anchors)
    own = State(state.table.join(shares, "node_id", "left").withColumn("shares", F.coalesce("shares", empty)), state.classes)
    both = with_state(pairs.select("i", "j"), own).where("type_id_i = type_id_j")
    square = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v * v)
    common = F.array_intersect(F.map_keys("shares_i"), F.map_keys("shares_j"))
    dot = F.aggregate(F.transform(common, lambda k: F.element_at("shares_i", k) * F.element_at("shares_j", k)), F.lit(0.0), lambda s, v: s + v)
    size = square("shares_i") + square("shares_j")
    context = F.greatest(size - 2 * dot, F.lit(0.0)) / F.greatest(size, F.lit(EPS))
    cost = lam["cov"] * context + lam["pur"] * divergence(F.col("cls_i"), F.col("cls_j")) + lam["spec"] * row_distance(F.col("sig_i"), F.col("sig_j")) + lam["rel"] * row_distance(F.col("rel_i"), F.col("rel_j")) + lam["feat"] * F.coalesce(row_distance(F.col("x_i"), F.col("x_j")), F.lit(0.0))
    rows = both.select("i", "j", F.col("type_id_i").alias("type_id"), F.col("part_id_i").alias("part_id"), F.round(cost, 9).alias("cost"))
    return greedy_cluster(rows, group, most_size, merges)
