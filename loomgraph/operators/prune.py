"""Relation-wise pruning: edge scores, budgets, plans, feature transforms and report rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import mixed, settled, sign
from ..graph import HeteroGraph


def edge_scores(edges: DataFrame, relations: DataFrame, how: str = "degree", target: int = 0, known: DataFrame | None = None, feature_types: tuple[int, ...] = (), bonus: dict[int, float] | None = None, strong: tuple[int, ...] = (), cap: float = 8.0, seed: int = 0) -> DataFrame:
    """edges with score. Degrees count a relation's edges; an edge's types are those of its relation, a table of few rows.

    degree: 1 / sqrt(d_s d_d). current: [touches the target type] + .25 / d_s + .25 / d_d.
    path_aware: degree + [touches the target type] + .8 [an end is known] + bonus of the relation for each known end + .1 (.2 in
    the `strong` relations) where both types have features + a tie breaker below 1e-6.
    path_aware_v2: [touches the target type] + [a type has features] + [an end is known] + 1 - .25 hub - .10 duplicate; hub is
    sqrt(d_s d_d) up to cap, duplicate d_s + d_d up to twice cap, each over its bound.
    random: a hash. known(node_id): nodes whose labels may be seen, those of training and validation."""
    if how == "random":
        return edges.select("rel_id", "src", "dst", "w", (mixed(F.col("src") * 31 + F.col("dst"), F.col("rel_id"), seed) / 2147483647.0).alias("score"))
    s = edges.groupBy("rel_id", "src").agg(F.count(F.lit(1)).alias("ds"))
    d = edges.groupBy("rel_id", "dst").agg(F.count(F.lit(1)).alias("dd"))
    rows = edges.join(s, ["rel_id", "src"]).join(d, ["rel_id", "dst"]).join(F.broadcast(relations.select("rel_id", "src_type", "dst_type")), "rel_id")
    touches = ((F.col("src_type") == target) | (F.col("dst_type") == target)).cast("double")
    inverse = 1.0 / F.sqrt(F.col("ds") * F.col("dd"))
    if how in ("path_aware", "path_aware_v2"):
        marks = known.select("node_id").distinct() if known is not None else edges.select(F.col("src").alias("node_id")).where("false")
        rows = rows.join(marks.select(F.col("node_id").alias("src"), F.lit(1.0).alias("ks")), "src", "left").join(marks.select(F.col("node_id").alias("dst"), F.lit(1.0).alias("kd")), "dst", "left").na.fill(0.0, ["ks", "kd"])
        has = lambda c: F.col(c).isin(list(feature_types)) if feature_types else F.lit(False)
    if how == "degree":
        score = inverse
    elif how == "current":
        score = touches + 0.25 / F.col("ds") + 0.25 / F.col("dd")
    elif how == "path_aware":
        extra = F.lit(0.0)
        for r, b in (bonus or {}).items():
            extra = F.when(F.col("rel_id") == r, b * (F.col("ks") + F.col("kd"))).otherwise(extra)
        both = (has("src_type") & has("dst_type")).cast("double")
        tie = ((F.col("src") * 1000003).bitwiseXOR(F.col("dst") * 9176).bitwiseXOR(F.lit(seed).cast("long")) % 997) * 1e-9
        score = inverse + touches + 0.8 * F.greatest("ks", "kd") + extra + F.when(F.col("rel_id").isin(list(strong)) if strong else F.lit(False), 0.2).otherwise(0.1) * both + tie
    elif how == "path_aware_v2":
        hub = F.least(F.sqrt(F.greatest(F.col("ds") * F.col("dd"), F.lit(1)).cast("double")), F.lit(cap)) / cap
        double = F.least((F.col("ds") + F.col("dd")).cast("double"), F.lit(2 * cap)) / (2 * cap)
        score = touches + (has("src_type") | has("dst_type")).cast("double") + F.greatest("ks", "kd") + 1.0 - 0.25 * hub - 0.10 * double
    else:
        raise ValueError(f"no edge score {how}")
    return rows.select("rel_id", "src", "dst", "w", score.alias("score"))


def allocate(capacity: dict[int, int], total: int, minimum: dict[int, int], weight: dict[int, float]) -> dict[int, int]:
    """Numbers that add up to min(total, all capacities): the minima, then shares by weight rounded down, then one by one, the
    largest remainder first (of equal ones the key that comes last as text), round after round until nothing is left or all is
    full. A total below the minima is an error. Weights that are all zero give way to the capacities."""
    plan = {r: min(capacity[r], minimum.get(r, 0)) for r in capacity}
    left = min(total, sum(capacity.values())) - sum(plan.values())
    if total < sum(plan.values()):
        raise ValueError(f"a total of {total} is below the minima, {sum(plan.values())}")
    active = [r for r in capacity if capacity[r] > plan[r]]
    whole = sum(max(weight.get(r, 0.0), 0.0) for r in active)
    if whole <= 0:
        weight = {r: float(capacity[r]) for r in active}
        whole = sum(weight.values())
    share = {r: left * max(weight.get(r, 0.0), 0.0) / whole for r in active} if active else {}
    for r, x in share.items():
        add = min(capacity[r] - plan[r], int(x))
        plan[r] += add
        left -= add
    turn = sorted(share, key=lambda r: (share[r] - int(share[r]), str(r)), reverse=True)
    while left > 0 and any(plan[r] < capacity[r] for r in turn):
        for r in turn:
            if left > 0 and plan[r] < capacity[r]:
                plan[r] += 1
                left -= 1
    return plan


def budgets(edges: DataFrame, total: int, minimum: int = 1, weight: str | dict[int, float] = "count", seed: int = 0) -> DataFrame:
    """(rel_id, edges, budget): how many edges each relation may keep, by allocate(). weight: count, volume, uniform, sqrt,
    random, or a weight for each relation, as from validation. One row for each relation reaches the driver."""
    rows = edges.groupBy("rel_id").agg(F.count(F.lit(1)).alias("edges"), F.sum("w").alias("volume"), F.first(mixed(F.col("rel_id").cast("long"), 0, seed)).alias("hash")).orderBy("rel_id").collect()
    by = {r.rel_id: {"count": float(r.edges), "volume": r.volume, "uniform": 1.0, "sqrt": r.edges**0.5, "random": (r.hash + 1) / 2147483648}[weight] for r in rows} if isinstance(weight, str) else weight
    plan = allocate({r.rel_id: r.edges for r in rows}, total, {r.rel_id: minimum for r in rows}, by)
    return plan_table(edges, [(r.rel_id, r.edges, plan[r.rel_id]) for r in rows])


def plan_table(edges: DataFrame, rows: list[tuple[int, int, int]]) -> DataFrame:
    return edges.sparkSession.createDataFrame(rows, "rel_id int, edges long, budget long")


def pair_weights(counts: dict[int, int], pairs: dict[int, str], shares: dict[str, float]) -> dict[int, float]:
    """Weights of relations from shares of pairs of relations: a pair's share is split by its relations' edges."""
    whole: dict[str, int] = {}
    for r, n in counts.items():
        whole[pairs[r]] = whole.get(pairs[r], 0) + n
    return {r: shares.get(pairs[r], 0.0) * n / max(whole[pairs[r]], 1) for r, n in counts.items()}


def keep_top(scored: DataFrame, plan: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """The best edges of each relation within its budget: required ones first, then by score, then by ends.

    A relation can hold most edges, so edges are ranked within score ranges that are offset by the ranges above."""
    rows = scored.withColumn("must", F.lit(0)) if required is None else scored.join(required.select("rel_id", "src", "dst").distinct().withColumn("m", F.lit(1)), ["rel_id", "src", "dst"], "left").withColumn("must", F.coalesce("m", F.lit(0))).drop("m")
    rows = rows.withColumn("key", F.round(F.col("score"), 9) + F.col("must") * 1e6)
    marks = rows.groupBy("rel_id").agg(F.percentile_approx("key", [k / 32 for k in range(1, 32)], 2000).alias("q"))
    placed = rows.join(F.broadcast(marks), "rel_id").withColumn("b", F.size(F.filter(F.array_distinct("q"), lambda x: x >= F.col("key")))).drop("q")
    sizes = placed.groupBy("rel_id", "b").count()
    before = sizes.withColumn("ahead", F.coalesce(F.sum("count").over(W.partitionBy("rel_id").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    r = F.row_number().over(W.partitionBy("rel_id", "b").orderBy(F.desc("key"), "src", "dst"))
    out = placed.withColumn("r", r).join(F.broadcast(before), ["rel_id", "b"]).join(F.broadcast(plan.select("rel_id", "budget")), "rel_id")
    return out.where(F.col("r") + F.col("ahead") <= F.col("budget")).select("rel_id", "src", "dst", "w", "score")


def mandatory(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rel_id, src, dst): the first edge that touches the largest id of each type."""
    top = nodes.groupBy("type_id").agg(F.max("node_id").alias("n"))
    both = edges.select("rel_id", "src", "dst", F.explode(F.array("src", "dst")).alias("n")).join(F.broadcast(top), "n")
    return both.groupBy("type_id").agg(F.min(F.struct("rel_id", "src", "dst")).alias("m")).select("m.rel_id", "m.src", "m.dst").distinct()


def channel_spec(text: DataFrame, column: str = "spec") -> DataFrame:
    """(spec, channel, per_cent) from texts such as AB30-BC05."""
    found = F.explode(F.regexp_extract_all(F.col(column), F.lit("([A-Z]+)([0-9]+)"), F.lit(0))).alias("c")
    return text.select(F.col(column).alias("spec"), found).select("spec", F.regexp_extract("c", "^[A-Z]+", 0).alias("channel"), F.regexp_extract("c", "[0-9]+$", 0).cast("int").alias("per_cent"))


def cost_share_plan(edges: DataFrame, limit: float = 0.2) -> DataFrame:
    """(rel_id, share, keep, utility): keep all of relations with at most `limit` of the edges, half of the others."""
    counts = edges.groupBy("rel_id").count()
    share = F.col("count") / F.sum("count").over(W.partitionBy(F.lit(0)))
    return counts.withColumn("share", share).select("rel_id", "share", F.when(F.col("share") <= limit, 1.0).otherwise(0.5).alias("keep"), (1.0 - F.col("share")).alias("utility"))


def random_sample(edges: DataFrame, per_cent: int, seed: int = 0) -> DataFrame:
    """The edges whose hash falls below a share: a sampling operator."""
    return edges.where(mixed(F.col("src") * 31 + F.col("dst"), F.col("rel_id"), seed) % 100 < per_cent)


def hub_capped(scored: DataFrame, cap: int) -> DataFrame:
    """Edges that are among the cap best of both their ends, by (score, ends)."""
    a = F.row_number().over(W.partitionBy("rel_id", "src").orderBy(F.desc(F.round("score", 9)), "dst"))
    b = F.row_number().over(W.partitionBy("rel_id", "dst").orderBy(F.desc(F.round("score", 9)), "src"))
    return scored.withColumn("a", a).withColumn("b", b).where((F.col("a") <= cap) & (F.col("b") <= cap)).select("rel_id", "src", "dst", "w", "score")


def coverage_sample(scored: DataFrame, plan: DataFrame, cap: int, settle=settled) -> DataFrame:
    """(rel_id, src, dst, w, score, rescued): in the order of (score descending, ends) each relation's edges whose source and
    destination both have fewer than cap edges by then, up to its budget; then, rescued, the best others up to it.

    By rounds: an edge that is among as many best of both its ends as those still may take is taken whatever comes before it;
    then ends that are full drop out. The result is that of the sequential scan."""
    key = ["rel_id", "src", "dst"]
    rows = settle(scored.select(*key, "w", F.round("score", 9).alias("score")))
    left = rows
    used_s = rows.select("rel_id", "src").distinct().withColumn("us", F.lit(0)).where("false")
    used_d = rows.select("rel_id", "dst").distinct().withColumn("ud", F.lit(0)).where("false")
    taken = None
    while not left.isEmpty():
        both = left.join(used_s, ["rel_id", "src"], "left").join(used_d, ["rel_id", "dst"], "left").na.fill(0, ["us", "ud"])
        a = F.row_number().over(W.partitionBy("rel_id", "src").orderBy(F.desc("score"), "dst"))
        b = F.row_number().over(W.partitionBy("rel_id", "dst").orderBy(F.desc("score"), "src"))
        won = settle(both.withColumn("a", a).withColumn("b", b).where((F.col("a") + F.col("us") <= cap) & (F.col("b") + F.col("ud") <= cap)).select(*key, "w", "score"))
        taken = won if taken is None else taken.unionByName(won)
        used_s = settle(taken.groupBy("rel_id", "src").agg(F.count(F.lit(1)).cast("int").alias("us")))
        used_d = settle(taken.groupBy("rel_id", "dst").agg(F.count(F.lit(1)).cast("int").alias("ud")))
        left = left.join(won, key, "left_anti").join(used_s.where(F.col("us") >= cap), ["rel_id", "src"], "left_anti").join(used_d.where(F.col("ud") >= cap), ["rel_id", "dst"], "left_anti")
        left = settle(left.select(*key, "w", "score"))
    if taken is None:
        return rows.withColumn("rescued", F.lit(False))
    first = settle(keep_top(taken, plan))
    had = first.groupBy("rel_id").agg(F.count(F.lit(1)).alias("had"))
    more = plan.join(F.broadcast(had), "rel_id", "left").select("rel_id", (F.col("budget") - F.coalesce("had", F.lit(0))).alias("budget"))
    rest = keep_top(rows.join(taken, key, "left_anti"), more)
    return first.withColumn("rescued", F.lit(False)).unionByName(rest.withColumn("rescued", F.lit(True)))


def sample_report(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """(rel_id, sources, destinations, kept_sources, kept_destinations, largest, p95, gini_before, gini_after): what a sample of each
    relation covers, and how uneven degrees over both ends are."""

    def degrees(e):
        return e.groupBy("rel_id", F.lit("s").alias("side"), F.col("src").alias("n")).agg(F.count(F.lit(1)).alias("d")).unionByName(e.groupBy("rel_id", F.lit("d").alias("side"), F.col("dst").alias("n")).agg(F.count(F.lit(1)).alias("d")))

    before, after = degrees(edges), degrees(kept)
    of = lambda d, a, b: d.groupBy("rel_id").agg(F.sum((F.col("side") == "s").cast("long")).alias(a), F.sum((F.col("side") == "d").cast("long")).alias(b))
    ends = of(before, "sources", "destinations").join(of(after, "kept_sources", "kept_destinations"), "rel_id", "left")
    # each end counts as often as it has edges
    many = after.select("rel_id", "d", F.explode(F.sequence(F.lit(1), F.col("d"))).alias("__k")).groupBy("rel_id").agg(F.max("d").alias("largest"), F.percentile("d", F.lit(0.95)).alias("p95"))
    return ends.join(many, "rel_id", "left").join(gini(before, ["rel_id"], "d").withColumnRenamed("gini", "gini_before"), "rel_id").join(gini(after, ["rel_id"], "d").withColumnRenamed("gini", "gini_after"), "rel_id", "left")


def gini(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, gini) of positive numbers: 2 sum(rank x) / (n sum x) - (n + 1) / n. Equal numbers share their middle rank, so only
    the counts of distinct numbers are ranked."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    w = W.partitionBy(*by).orderBy(value)
    before = F.coalesce(F.sum("__c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = counts.withColumn("__r", before + (F.col("__c") + 1) / 2)
    n, s = F.sum("__c"), F.sum(F.col("__c") * F.col(value))
    value_of = 2 * F.sum(F.col("__c") * F.col("__r") * F.col(value)) / (n * s) - (n + 1) / n
    return rows.groupBy(*by).agg(F.when(s > 0, value_of).otherwise(0.0).alias("gini"))


def parse_spec(text: str, relations: dict[str, int]) -> dict[int, float]:
    """Shares to keep by relation from a text such as AB30-BC05: a name of a relation, or two names of relations in a row for both,
    and per cent. Relations that are not named keep all."""
    out = dict.fromkeys(relations.values(), 1.0)
    for name, cent in re.findall(r"([A-Za-z_]+?)(\d+)(?:-|$)", text):
        pairs = [(name[:k], name[k:]) for k in range(1, len(name)) if name[:k] in relations and name[k:] in relations]
        if name in relations:
            out[relations[name]] = int(cent) / 100
        elif pairs:
            out |= dict.fromkeys((relations[x] for x in pairs[0]), int(cent) / 100)
        else:
            raise ValueError(f"no relation {name}")
    return out


def skeleton_plan(edges: DataFrame, shares: dict[int, float], minimum: int = 1, keep_schema: bool = True) -> DataFrame:
    """(rel_id, edges, budget): each relation's share of its edges, rounded, and if the schema is kept at least `minimum`."""
    rows = edges.groupBy("rel_id").agg(F.count(F.lit(1)).alias("n")).orderBy("rel_id").collect()
    want = {r.rel_id: round(r.n * shares.get(r.rel_id, 0.0)) for r in rows}
    return plan_table(edges, [(r.rel_id, r.n, min(r.n, max(want[r.rel_id], min(r.n, minimum) if keep_schema else 0))) for r in rows])


def skeleton(edges: DataFrame, shares: dict[int, float], minimum: int = 1, keep_schema: bool = True, seed: int = 0) -> DataFrame:
    """The edges of a skeleton: of each relation its budget, by a hash of the edge."""
    score = edges.select("rel_id", "src", "dst", "w", (mixed(F.col("src") * 31 + F.col("dst"), F.col("rel_id"), seed) / 2147483647.0).alias("score"))
    return keep_top(score, skeleton_plan(edges, shares, minimum, keep_schema)).select("rel_id", "src", "dst", "w")


def stable_budgets(counts: dict[int, int], total: int, share: float = 0.01, uniform: bool = False) -> dict[int, int]:
    """Budgets that leave each relation with edges some: max(1, floor(share m)), the rest in proportion to edges or evenly, then
    one more to as many as are left, the largest remainder first (ties: the larger relation id)."""
    plan = {r: min(m, max(1, int(m * share))) for r, m in counts.items() if m}
    left = max(0, total - sum(plan.values()))
    weight = {r: 1.0 if uniform else float(counts[r]) for r in plan}
    whole = sum(weight.values()) or 1.0
    raw = {r: left * weight[r] / whole for r in plan}
    for r in plan:
        plan[r] += min(counts[r] - plan[r], int(raw[r]))
    rest = max(0, total - sum(plan.values()))
    for r in sorted(raw, key=lambda r: (raw[r] - int(raw[r]), r), reverse=True):
        if rest > 0 and plan[r] < counts[r]:
            plan[r] += 1
            rest -= 1
    return {r: plan.get(r, 0) for r in counts}


def schema_stable(graph: HeteroGraph, target: int, support: DataFrame, storage: float | None = None, edge_share: float | None = None, share: float = 0.01, uniform: bool = False, how: str = "current") -> HeteroGraph:
    """Targets and support with so many of the edges between them as a ratio of storage (nodes and edges) or of edges allows, by
    stable_budgets; edges that touch a type's largest id come first."""
    part = graph.induced(graph.nodes_of_type(target).select("node_id").unionByName(support.select("node_id")))
    rows = part.edges.groupBy("rel_id").agg(F.count(F.lit(1)).alias("n")).orderBy("rel_id").collect()
    counts, nodes = {r.rel_id: r.n for r in rows}, part.nodes.count()
    m = sum(counts.values())
    total = int(storage * (nodes + m) - nodes) if storage is not None else int(edge_share * m) if edge_share is not None else m
    plan = stable_budgets(counts, min(m, max(len(counts), total)), share, uniform)
    kept = keep_top(edge_scores(part.edges, part.relations, how, target), plan_table(part.edges, [(r, counts[r], plan[r]) for r in counts]), mandatory(part.edges, part.nodes))
    return HeteroGraph(part.nodes, kept.select("rel_id", "src", "dst", "w"), part.relations, part.features)


def schema_stub(graph: HeteroGraph, target: int) -> HeteroGraph:
    """All targets and one node, the least id, for each other type, which has the type's mean features; each relation gets an edge
    between the first nodes of its types, and where a type is the target's one for its last node too."""
    ends = graph.nodes.groupBy("type_id").agg(F.min("node_id").alias("lo"), F.max("node_id").alias("hi")).withColumn("hi", F.when(F.col("type_id") == target, F.col("hi")).otherwise(F.col("lo")))
    others = ends.where(F.col("type_id") != target).select(F.col("lo").alias("node_id"), "type_id")
    nodes = graph.nodes_of_type(target).unionByName(others.join(graph.nodes.select("node_id", "part_id"), "node_id").select("node_id", "type_id", F.lit(-1).alias("label"), "part_id"))
    s = ends.select(F.col("type_id").alias("src_type"), F.col("lo").alias("slo"), F.col("hi").alias("shi"))
    d = ends.select(F.col("type_id").alias("dst_type"), F.col("lo").alias("dlo"), F.col("hi").alias("dhi"))
    pairs = F.array_distinct(F.array(F.struct(F.col("slo").alias("src"), F.col("dlo").alias("dst")), F.struct(F.col("shi").alias("src"), F.col("dlo").alias("dst")), F.struct(F.col("slo").alias("src"), F.col("dhi").alias("dst"))))
    edges = graph.relations.join(s, "src_type").join(d, "dst_type").select("rel_id", F.explode(pairs).alias("e")).select("rel_id", "e.src", "e.dst", F.lit(1.0).alias("w"))
    long = graph.features.where(F.col("type_id") != target).select("type_id", F.posexplode("x").alias("j", "v")).groupBy("type_id", "j").agg(F.avg("v").alias("v"))
    means = long.groupBy("type_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda e: e["v"]).alias("x"))
    features = graph.features.where(F.col("type_id") == target).select("node_id", "type_id", "x").unionByName(others.join(F.broadcast(means), "type_id").select("node_id", "type_id", "x"))
    return HeteroGraph(nodes, edges, graph.relations, features)


def channel_utilities(channels: DataFrame) -> DataFrame:
    """channels (channel, cost, removal, reach, purity, saturation, redundancy, hub) with utility and utility a unit of cost."""
    u = 2.0 * F.col("removal") + F.col("reach") + 0.7 * F.col("purity") + 0.5 * F.col("saturation") - F.col("redundancy") - 0.5 * F.col("hub")
    return channels.withColumn("utility", u).withColumn("density", F.col("utility") / F.greatest("cost", F.lit(1e-12)))


def plan_channels(channels: DataFrame, budget: float) -> DataFrame:
    """The channels of a budget: the densest first (ties by channel), each that still fits. A few rows, chosen on the driver."""
    rows, left, names = channel_utilities(channels).orderBy(F.desc(F.round("density", 9)), "channel").collect(), budget, []
    for r in rows:
        if r.cost <= left + 1e-12:
            names.append(r.channel)
            left -= r.cost
    return channel_utilities(channels).where(F.col("channel").isin(names))


def closure_compress(edges: DataFrame, forward: int, backward: int, share: float, closures: list[int]) -> tuple[DataFrame, DataFrame]:
    """(edges, features): the last type of relation `forward` keeps the round(n share) nodes with the most of its edges (at least
    one, ties by id), its edges and those of `backward` to others go. features (node_id, key, v): 1 for each kept node that a
    source leads to, and for the sources of each closure relation the union of what their destinations have."""
    counts = edges.where(F.col("rel_id") == forward).groupBy(F.col("dst").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    k = max(1, round(counts.count() * share))
    kept = counts.orderBy(F.desc("n"), "key").limit(k).select("key")
    far = edges.where(F.col("rel_id") == forward).join(kept.withColumnRenamed("key", "dst"), "dst", "left_semi")
    near = edges.where(F.col("rel_id") == backward).join(kept.withColumnRenamed("key", "src"), "src", "left_semi")
    out = edges.where(~F.col("rel_id").isin(forward, backward)).unionByName(far.select(edges.columns)).unionByName(near.select(edges.columns))
    own = far.select(F.col("src").alias("node_id"), F.col("dst").alias("key")).distinct()
    features = own
    for r in closures:
        features = features.unionByName(edges.where(F.col("rel_id") == r).select(F.col("src").alias("n"), F.col("dst").alias("node_id")).join(own, "node_id").select(F.col("n").alias("node_id"), "key").distinct())
    return out, features.distinct().withColumn("v", F.lit(1.0))


def channel_compress(edges: DataFrame, shares: dict[int, float], reverse: dict[int, int], seed: int = 0) -> DataFrame:
    """Each relation of `reverse` keeps its share of edges by a hash (all of those without one), and the first edge to its largest
    destination; the relation that it maps to becomes its exact reverse. Other relations stay."""
    plan = skeleton_plan(edges.where(F.col("rel_id").isin(list(reverse))), {r: shares.get(r, 1.0) for r in reverse})
    mine = edges.where(F.col("rel_id").isin(list(reverse)))
    score = mine.select("rel_id", "src", "dst", "w", (mixed(F.col("src") * 31 + F.col("dst"), F.col("rel_id"), seed) / 2147483647.0).alias("score"))
    chosen = keep_top(score, plan).select("rel_id", "src", "dst", "w")
    last = mine.groupBy("rel_id").agg(F.max("dst").alias("dst"))
    rescue = mine.join(F.broadcast(last), ["rel_id", "dst"]).groupBy("rel_id", "dst").agg(F.min("src").alias("src"))
    missing = rescue.join(chosen.select("rel_id", "dst").distinct(), ["rel_id", "dst"], "left_anti")
    chosen = chosen.unionByName(mine.join(missing, ["rel_id", "src", "dst"]).select("rel_id", "src", "dst", "w"))
    to = F.element_at(F.create_map(*[F.lit(x) for p in reverse.items() for x in p]), F.col("rel_id"))
    back = chosen.select(to.alias("rel_id"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    rest = edges.where(~F.col("rel_id").isin([*reverse, *reverse.values()]))
    return rest.unionByName(chosen).unionByName(back)


def quota_counts(counts: dict[int, int], budget: float, weight: dict[int, float], least: float = 0.05) -> dict[int, int]:
    """How many edges of each relation: one each, then one by one to the relation of the largest weight times edges left (ties:
    the smaller id) until round(m budget) are given out."""
    import heapq

    plan = {r: 1 if m else 0 for r, m in counts.items()}
    left = max(0, max(len(counts), min(sum(counts.values()), round(sum(counts.values()) * budget))) - sum(plan.values()))
    heap = [(-weight.get(r, least) * (m - plan[r]), r) for r, m in counts.items() if plan[r] < m]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, r = heapq.heappop(heap)
        # the top stays the top until another one's value is passed: take so many at once
        w, room = weight.get(r, least), counts[r] - plan[r]
        step = 1
        if heap and w > 0:
            step = max(1, min(room, int(room + heap[0][0] / w)))
        elif not heap:
            step = room
        step = min(step, left, room)
        plan[r] += step
        left -= step
        if plan[r] < counts[r]:
            heapq.heappush(heap, (-w * (counts[r] - plan[r]), r))
    return plan


def score_selector(graph: HeteroGraph, budget: float, weight: dict[int, float], target: int = 0, strong: tuple[int, ...] = (), middle: tuple[int, ...] = (), seed: int = 0) -> DataFrame:
    """Edges by relation quotas and, within a relation, by the degrees of both ends plus 2 at a target plus 2, .75 or .25 for its
    relation's rank, ties by a hash; the first edge of each type's largest id is added where it is missing."""
    counts = {r.rel_id: r.n for r in graph.edges.groupBy("rel_id").agg(F.count(F.lit(1)).alias("n")).orderBy("rel_id").collect()}
    plan = plan_table(graph.edges, [(r, n, p) for (r, n), p in zip(counts.items(), quota_counts(counts, budget, weight).values(), strict=True)])
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("d"))
    rows = graph.edges.join(ends.withColumnsRenamed({"n": "src", "d": "ds"}), "src").join(ends.withColumnsRenamed({"n": "dst", "d": "dd"}), "dst").join(F.broadcast(graph.relations.select("rel_id", "src_type", "dst_type")), "rel_id")
    kind = lambda s: F.col("rel_id").isin(list(s)) if s else F.lit(False)
    score = F.col("ds") + F.col("dd") + F.when((F.col("src_type") == target) | (F.col("dst_type") == target), 2.0).otherwise(0.0) + F.when(kind(strong), 2.0).when(kind(middle), 0.75).otherwise(0.25)
    jitter = (1.0 - mixed(F.col("src") * 31 + F.col("dst"), F.col("rel_id"), seed) / 2147483647.0) * 1e-3
    scored = rows.select("rel_id", "src", "dst", "w", (score + jitter).alias("score"))
    first = mandatory(graph.edges, graph.nodes)
    chosen = keep_top(scored, plan).select("rel_id", "src", "dst", "w")
    extra = graph.edges.join(F.broadcast(first), ["rel_id", "src", "dst"], "left_semi").join(chosen, ["rel_id", "src", "dst"], "left_anti")
    return chosen.unionByName(extra.select("rel_id", "src", "dst", "w"))


def ordered_links(edges: DataFrame, order: list[int]) -> DataFrame:
    """Edges sorted by the place of their relation in `order`, then by ends."""
    return edges.orderBy(F.array_position(F.array(*[F.lit(r) for r in order]), F.col("rel_id")), "src", "dst")


def support_proxies(graph: HeteroGraph, target: int, known: DataFrame) -> DataFrame:
    """(node_id, type_id, degrees, targets, two_steps, labels): of each support node its edges by relation as a map, how many targets
    it is next to and how many lie two steps away over another support node, and a map of known labels next to it."""
    both = graph.edges.select("rel_id", F.col("src").alias("node_id"), F.col("dst").alias("to")).unionByName(graph.edges.select("rel_id", F.col("dst").alias("node_id"), F.col("src").alias("to")))
    kinds = graph.nodes.select("node_id", "type_id")
    mine = both.join(kinds.where(F.col("type_id") != target).select("node_id"), "node_id", "left_semi")
    of = mine.groupBy("node_id", "rel_id").agg(F.count(F.lit(1)).alias("c")).groupBy("node_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rel_id", "c")))).alias("degrees"))
    near = mine.join(kinds.where(F.col("type_id") == target).select(F.col("node_id").alias("to")), "to", "left_semi").select("node_id", "to").distinct()
    reach = near.groupBy("node_id").agg(F.count(F.lit(1)).alias("targets"))
    over = mine.select("node_id", F.col("to").alias("m")).distinct().join(near.select(F.col("node_id").alias("m"), "to"), "m").groupBy("node_id").agg(F.countDistinct("to").alias("two_steps"))
    hist = near.join(known.select(F.col("node_id").alias("to"), "label"), "to").groupBy("node_id", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("node_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "c")))).alias("labels"))
    out = kinds.where(F.col("type_id") != target).join(of, "node_id", "left").join(reach, "node_id", "left").join(over, "node_id", "left").join(hist, "node_id", "left")
    return out.na.fill(0, ["targets", "two_steps"])


def random_support(nodes: DataFrame, target: int, ratio: float, seed: int = 0) -> DataFrame:
    """(node_id): round(n ratio) support nodes by a hash."""
    rows = nodes.where(F.col("type_id") != target).select("node_id")
    return rows.orderBy(mixed(F.col("node_id"), 1, seed), "node_id").limit(round(rows.count() * ratio))


def reach_report(graph: HeteroGraph, target: int, first: tuple[int, int], then: tuple[int, int]) -> DataFrame:
    """How far targets reach over two pairs of relations, each (forward, backward): how many have an edge of the first forward one,
    reach its other end at all, reach the second end over forward relations and at all; isolated ones; mean, median and 10th and
    90th percentile of forward degrees; and how many nodes are reached at both steps."""
    e = lambda r: graph.edges.where(F.col("rel_id") == r)
    turn = lambda df: df.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    straight = lambda df: df.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    out1, any1 = straight(e(first[0])).distinct(), straight(e(first[0])).unionByName(turn(e(first[1]))).distinct()
    out2, any2 = straight(e(then[0])).distinct(), straight(e(then[0])).unionByName(turn(e(then[1]))).distinct()
    t = graph.nodes_of_type(target).select(F.col("node_id").alias("a"))
    degree = t.join(out1.groupBy("a").agg(F.count(F.lit(1)).alias("d")), "a", "left").na.fill(0, ["d"])
    on = any1.join(t, "a", "left_semi")
    far = lambda one, two: one.join(t, "a", "left_semi").select("a", F.col("b").alias("m")).join(two.select(F.col("a").alias("m"), F.col("b").alias("c")), "m")
    count = lambda df, c, n: df.agg(F.countDistinct(c).alias(n))
    p = lambda q, n: F.percentile("d", F.lit(q)).alias(n)
    row = degree.agg(F.count(F.lit(1)).alias("targets"), F.sum((F.col("d") > 0).cast("long")).alias("with_edge"), F.avg("d").alias("degree_mean"), p(0.5, "degree_p50"), p(0.1, "degree_p10"), p(0.9, "degree_p90"))
    for part in (count(on, "a", "reaching"), count(on, "b", "reached"), count(far(out1, out2), "a", "reaching_far_forward"), count(far(any1, any2), "a", "reaching_far"), count(far(any1, any2), "c", "reached_far")):
        row = row.join(F.broadcast(part))
    return row.withColumn("isolated", F.col("targets") - F.col("reaching"))


def reachability(edges: DataFrame, nodes: DataFrame, target: int, hops: int) -> DataFrame:
    """(hop, reached): how many nodes lie within so many steps of a target."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = nodes.where(F.col("type_id") == target).select(F.col("node_id").alias("src"))
    out = seen.agg(F.lit(0).alias("hop"), F.count(F.lit(1)).alias("reached"))
    for h in range(1, hops + 1):
        seen = seen.unionByName(both.join(seen, "src").select(F.col("dst").alias("src"))).distinct()
        out = out.unionByName(seen.agg(F.lit(h).alias("hop"), F.count(F.lit(1)).alias("reached")))
    return out


def pareto(rows: DataFrame, cost: str, gains: list[str]) -> DataFrame:
    """Rows that no other dominates: no dearer, no worse in any gain, better in one. For report tables of few rows."""
    other = rows.select(F.col(cost).alias("oc"), *[F.col(g).alias(f"o_{g}") for g in gains])
    no_worse = F.col("oc") <= F.col(cost) + 1e-12
    better = F.col("oc") < F.col(cost) - 1e-12
    for g in gains:
        no_worse &= F.col(f"o_{g}") >= F.col(g) - 1e-12
        better |= F.col(f"o_{g}") > F.col(g) + 1e-12
    return rows.join(F.broadcast(other), no_worse & better, "left_anti")


def representative_rows(rows: DataFrame, by: list[str], pool: DataFrame | None = None) -> DataFrame:
    """(by, kind, row's columns): the best row of each group by (validation micro, validation macro, -cost, method), and, flagged as
    test_oracle, the best by the same of the test. Rows without a measure are left out."""

    def best(df, kind, micro, macro):
        have = df.where(F.col(micro).isNotNull() & F.col(macro).isNotNull())
        return representative(have, by, [F.desc(micro), F.desc(macro), F.col("cost"), F.col("method")]).withColumn("kind", F.lit(kind))

    return best(rows if pool is None else pool, "validated", "val_micro", "val_macro").unionByName(best(rows, "test_oracle", "test_micro", "test_macro"))


def budget_truth(rows: DataFrame, fields: dict[str, str], tolerance: float = 0.03) -> DataFrame:
    """rows (budget_type, requested, and measures) with the measure that the budget's type names, whether it keeps the budget, and
    why not: missing_requested_budget_type, missing_requested_budget, unsupported_budget_type, metric_missing or budget_mismatch."""
    kind = F.trim(F.coalesce("budget_type", F.lit("")))
    metric, field = F.lit(None).cast("double"), F.lit(None).cast("string")
    for k, f in fields.items():
        metric, field = F.when(kind == k, F.col(f)).otherwise(metric), F.when(kind == k, F.lit(f)).otherwise(field)
    fault = F.when(kind == "", "missing_requested_budget_type").when(F.col("requested").isNull(), "missing_requested_budget").when(field.isNull(), "unsupported_budget_type").when(metric.isNull(), "metric_missing").when(metric > F.col("requested") + tolerance, "budget_mismatch").otherwise("")
    return rows.withColumn("metric", field).withColumn("actual", metric).withColumn("fault", fault).withColumn("match", F.col("fault") == "")


def ratio_audit(rows: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """rows (nodes, edges, nodes0, edges0, reported) with the storage ratio that follows and whether the reported one is it."""
    ratio = (F.col("nodes") + F.col("edges")) / F.greatest(F.col("nodes0") + F.col("edges0"), F.lit(1))
    return rows.withColumn("ratio", ratio).withColumn("consistent", F.abs(ratio - F.col("reported")) <= tolerance)


def representative(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    """The first row of each group by `order`."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where("__r = 1").drop("__r")


def run_statistics(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, n, mean, std_sample, std_population)."""
    return rows.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std_sample"), F.stddev_pop(value).alias("std_population"))


def int8_features(features: DataFrame) -> DataFrame:
    """(node_id, j, q): columns of a type scaled to 0..255; a column of one value has scale 1."""
    long = features.select("node_id", "type_id", F.posexplode("x").alias("j", "v"))
    ends = long.groupBy("type_id", "j").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    step = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / 255.0).otherwise(1.0)
    return long.join(F.broadcast(ends), ["type_id", "j"]).select("node_id", "j", F.floor(F.round((F.col("v") - F.col("lo")) / step, 6) + 0.5).cast("int").alias("q"))


def half_precision(features: DataFrame) -> DataFrame:
    """Features as numbers of half precision hold them: 11 bits, ties to even; beyond 65504 they are cut, below 2**-14 coarser."""

    def half(v):
        e = F.greatest(F.floor(F.log2(F.abs(v))), F.lit(-14))
        step = F.pow(F.lit(2.0), e - 10)
        return F.when(v == 0, 0.0).otherwise(F.greatest(F.least(F.rint(v / step) * step, F.lit(65504.0)), F.lit(-65504.0)))

    return features.select("node_id", "type_id", F.transform("x", half).alias("x"))


def transform_features(features: DataFrame, how: str, types: tuple[int, ...], k: int = 0, seed: int = 3) -> DataFrame:
    """Features of the named types changed, all others as they are: zero, constant (type_id + 1 in each place), only (all but the
    named types zero), half, project (times a random sign matrix) or pca, to k dimensions."""
    mine = F.col("type_id").isin(list(types))
    if how in ("zero", "only"):
        hit = mine if how == "zero" else ~mine
        return features.select("node_id", "type_id", F.when(hit, F.transform("x", lambda v: F.lit(0.0))).otherwise(F.col("x")).alias("x"))
    if how == "constant":
        return features.select("node_id", "type_id", F.when(mine, F.transform("x", lambda v: F.col("type_id") + 1.0)).otherwise(F.col("x")).alias("x"))
    rest, part = features.where(~mine).select("node_id", "type_id", "x"), features.where(mine)
    if how == "half":
        return rest.unionByName(half_precision(part))
    if how == "project":
        made = random_projection(part, k, seed).select("node_id", F.array(*[f"v{j}" for j in range(k)]).alias("x"))
        return rest.unionByName(part.select("node_id", "type_id").join(made, "node_id").select("node_id", "type_id", "x"))
    if how == "pca":
        from .linalg import columns
        from .scoring import pca_projection

        for t in types:
            made = pca_projection(features, t, k)
            rest = rest.unionByName(made.select("node_id", F.lit(t).alias("type_id"), F.array(*columns(made)).alias("x")))
        return rest
    raise ValueError(f"no transform {how}")


def random_projection(features: DataFrame, k: int, seed: int = 3) -> DataFrame:
    """Dense rows: features times a random sign matrix over sqrt(k)."""
    one = lambda j: F.aggregate(F.transform("x", lambda v, i: v * sign(i.cast("long"), j, seed)), F.lit(0.0), lambda s, v: s + v)
    return features.select("node_id", *[(one(j) / float(k) ** 0.5).alias(f"v{j}") for j in range(k)])


def rollup_gate(rows: DataFrame, flags: list[str]) -> DataFrame:
    """(passed, failed_rows): whether all flags hold in all rows."""
    ok = F.lit(True)
    for f in flags:
        ok &= F.coalesce(F.col(f), F.lit(False))
    return rows.agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("passed"), F.coalesce(F.sum((~ok).cast("long")), F.lit(0).cast("long")).alias("failed_rows"))
