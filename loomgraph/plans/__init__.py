"""The multilevel plan: sketch, candidates, costs, guards, matching and aggregation, level by level, with checkpoints."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import deep_update, fingerprint, load_config
from ..functions import settled
from ..graph import HeteroGraph
from ..operators import candidates as C
from ..operators import coarsen as A
from ..operators import diagnostics as G
from ..operators import linalg as L
from ..operators import matching as M
from ..operators import scoring as S
from ..operators import sketch as Z
from ..sources import exists, load_graph, read_json, save_graph, write_json


@dataclass
class Level:
    """One level's tables: assignment (node_id, super_id), the pairs that were merged with their terms, all retained candidates
    and the sketch."""

    assignment: DataFrame
    merged: DataFrame
    candidates: DataFrame
    sketch: DataFrame


def relation_alpha(graph: HeteroGraph, config: dict) -> dict[int, float]:
    """Relation weights by the configured method; one row for each relation reaches the driver."""
    w = config["weights"]
    ids = [r.rel_id for r in graph.relations.select("rel_id").orderBy("rel_id").collect()]
    if w["method"] == "uniform":
        return {r: 1.0 / len(ids) for r in ids}
    x = Z.feature_basis(graph.nodes, graph.features) if w["method"] == "feature_smoothness" else L.probe(graph.nodes, w["basis"], config["seed"] + 11)
    got = {r.rel_id: r.alpha for r in Z.relation_weights(Z.relation_energy(graph.edges, x), w["method"], w["eta"]).collect()}
    return {r: got.get(r, 0.0) for r in ids}


def find_candidates(graph: HeteroGraph, sketch: DataFrame, config: dict) -> DataFrame:
    """(i, j, score, source) of all configured sources, the best of each node. Scores are distances of sketches, 0 for buckets."""
    c, parts = config["candidates"], []
    for source in c["sources"]:
        if source == "onehop":
            parts.append(C.onehop(graph.edges, graph.nodes, sketch))
        elif source == "twohop":
            cap = c["hub_cap"]
            if c["hub_percentile"] is not None:
                cap = min(cap, C.degree_cap(C.incident_index(graph.edges, graph.nodes), c["hub_percentile"]).first().cap or 1)
            found = C.twohop(graph.edges, graph.nodes, cap, c["pair_cap"], config["seed"])
            parts.append(C.with_distance(found, sketch).select("i", "j", "score", "source"))
        elif source == "bucket":
            parts.append(C.bucket_pairs(Z.simhash(sketch, graph.nodes, c["bits"]), c["per_bucket"]))
        elif source == "ann":
            names = L.columns(sketch)[:2]
            parts.append(C.ann_window(sketch.select("node_id", *[F.round(n, 9).alias(n) for n in names]), graph.nodes, max(1, c["window"])))
        elif source == "fallback":
            parts.append(C.fallback(graph.nodes))
        else:
            raise ValueError(f"no source {source}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return C.retain(out, c["keep"])


def one_level(graph: HeteroGraph, config: dict, merges: int, settle: Callable = settled) -> Level:
    """At most `merges` merges of one level. Every table that more than one step reads is settled once."""
    alpha = relation_alpha(graph, config)
    edges = settle(L.normalized(graph.edges))
    s = config["sketch"]
    sketch = settle(Z.lowpass_sketch(edges, graph.nodes, alpha, s["method"], s["dim"], s["order"], tuple(s["times"]), s["last"], config["seed"], settle))
    found = settle(find_candidates(graph, sketch, config))
    table = S.node_table(graph.nodes, graph.edges, list(alpha), graph.features, sketch, L.fused(edges, sketch, alpha))
    lambdas = {t: config["scoring"][t] for t in S.LAMBDAS}
    scored = settle(S.score_pairs(found.select("i", "j", "source"), table, lambdas, config["scoring"]["normalization"]))
    guards = config["guards"]
    if guards["spectral"] is not None:
        scored = settle(S.spectral_guard(scored, guards["spectral"]))
    if guards["source"]:
        scored = settle(S.source_guard(scored))
    if guards["relation"]:
        scored = S.relation_guard(scored)
    pairs = settle(scored.withColumn("cost", F.round("cost", 9)))
    m = config["matching"]
    if m["method"] == "mutual_best":
        taken = settle(M.mutual_best(pairs, merges, settle))
        assignment = M.from_matching(taken, graph.nodes)
    elif m["method"] == "greedy":
        taken = settle(M.cheapest(M.greedy_grouped(pairs, ["type_id", "part_id"]), merges, settle))
        assignment = M.from_matching(taken, graph.nodes)
    elif m["method"] == "greedy_cluster":
        rows = pairs
        if m["protect"]:
            flags = settle(M.terminal_flags(graph.edges, graph.nodes))
            for e in "ij":
                rows = rows.join(flags.select(F.col("node_id").alias(e), F.col("protected").alias(f"guard_{e}")), e)
        taken = settle(M.greedy_cluster(rows, ["type_id", "part_id"], m["cluster"], merges, settle=settle))
        assignment = M.clusters(taken, graph.nodes, m["cluster"], settle)
    else:
        raise ValueError(f"no matching {m['method']}")
    assignment = settle(assignment)
    if m["repair"]:
        assignment = settle(M.repair_clusters(assignment, sketch, graph.nodes, objective=m["repair"]).select("node_id", "super_id"))
    return Level(assignment, settle(pairs.join(taken.select("i", "j"), ["i", "j"], "left_semi")), found, sketch)


def level_target(nodes: int, ratio: float) -> int:
    return max(1, -int(-(nodes * ratio) // 1))


def coarsen(graph: HeteroGraph, folder: str, config: dict | None = None) -> list[HeteroGraph]:
    """The graphs of all levels, each written under folder/level_k and read back, which cuts the lineage.

    A level whose folder is complete is read instead of made: an interrupted run goes on where it stopped. A folder that was
    begun under another configuration or on another graph is refused. folder/level_k holds the graph, the assignment, the
    cumulative assignment and a report; folder/plan.json the configuration."""
    config = deep_update(load_config(), config or {})
    spark, out = graph.nodes.sparkSession, []
    n = graph.nodes.count()
    mark = {"config": config, "fingerprint": fingerprint(config), "nodes": n, "edges": graph.edges.count()}
    if exists(spark, f"{folder}/plan.json"):
        before = read_json(spark, f"{folder}/plan.json")
        if any(before.get(k) != mark[k] for k in ("fingerprint", "nodes", "edges")):
            raise ValueError(f"{folder} holds a run of another configuration or graph")
    else:
        write_json(spark, f"{folder}/plan.json", mark)
    target, whole = level_target(n, config["target_ratio"]), None
    for k in range(config["levels"]):
        n = graph.nodes.count()
        merges = M.level_budget(n, target, config["per_level"])
        if merges <= 0:
            break
        path, clock = f"{folder}/level_{k}", G.Resources()
        if not exists(spark, f"{path}/report.json"):
            with clock.stage("level"):
                level = one_level(graph, config, merges)
                level.assignment.write.mode("overwrite").parquet(f"{path}/assignment")
            assignment = spark.read.parquet(f"{path}/assignment")
            with clock.stage("aggregate"):
                save_graph(A.coarse_graph(graph, assignment, config["features"]), path)
                (assignment if whole is None else A.compose(whole, assignment)).write.mode("overwrite").parquet(f"{path}/cumulative")
            coarse = load_graph(spark, path)
            row = G.level_report(graph.nodes, graph.edges, coarse.edges, assignment, level.candidates).first().asDict()
            write_json(spark, f"{path}/report.json", {"level": k, **row, **clock.row()})
        graph, whole = load_graph(spark, path), spark.read.parquet(f"{path}/cumulative")
        out.append(graph)
        if n - graph.nodes.count() <= 0:
            break
    return out


def reports(spark: SparkSession, folder: str) -> list[dict]:
    """The reports of the levels that are complete."""
    out, k = [], 0
    while exists(spark, f"{folder}/level_{k}/report.json"):
        out.append(read_json(spark, f"{folder}/level_{k}/report.json"))
        k += 1
    return out


def describe(graph: HeteroGraph) -> str:
    """A graph's tables as one line of JSON."""
    return json.dumps({"nodes": {r.type_id: r.n for r in graph.nodes.groupBy("type_id").agg(F.count(F.lit(1)).alias("n")).orderBy("type_id").collect()}, "edges": {r.rel_id: r.n for r in graph.edges.groupBy("rel_id").agg(F.count(F.lit(1)).alias("n")).orderBy("rel_id").collect()}})
