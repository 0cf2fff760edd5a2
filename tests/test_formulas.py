"""Formulas on small inputs, with numbers worked out by hand or by a sequential version."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.graph import HeteroGraph, neighbours, ranked
from loomgraph.operators import classify as K
from loomgraph.operators import diagnostics as G
from loomgraph.operators import linalg as L
from loomgraph.operators import matching as M
from loomgraph.operators import paths as H
from loomgraph.operators import prune as P
from loomgraph.operators import response as R
from loomgraph.operators import scoring as S
from loomgraph.operators import selection as N
from loomgraph.operators import sketch as Z


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def graph(spark, nodes, edges, relations, features=()):
    return HeteroGraph(
        spark.createDataFrame(nodes, "node_id long, type_id int, label int, part_id int"),
        spark.createDataFrame(edges, "rel_id int, src long, dst long, w double"),
        spark.createDataFrame(relations, "rel_id int, name string, src_type int, dst_type int"),
        spark.createDataFrame(list(features), "node_id long, type_id int, x array<double>"),
    )


@pytest.fixture(scope="module")
def papers(spark):
    """Four labelled papers, two authors, two terms; papers to authors, authors to terms, and back."""
    nodes = [(k, 0, k % 2, 0) for k in range(4)] + [(4, 1, -1, 0), (5, 1, -1, 0), (6, 2, -1, 0), (7, 2, -1, 0)]
    there = [(0, 4), (1, 4), (2, 5), (3, 5)]
    edges = [(0, a, b, 1.0) for a, b in there] + [(1, b, a, 1.0) for a, b in there] + [(2, 4, 6, 2.0), (2, 5, 7, 1.0), (3, 6, 4, 2.0), (3, 7, 5, 1.0)]
    relations = [(0, "paper__to__author", 0, 1), (1, "author__of__paper", 1, 0), (2, "author__to__term", 1, 2), (3, "term__of__author", 2, 1)]
    return graph(spark, nodes, edges, relations, [(k, 0, [float(k), 1.0]) for k in range(4)] + [(4, 1, [2.0]), (5, 1, [3.0])])


def test_relation_weights(spark):
    e = spark.createDataFrame([(0, 4.0, 1.0), (1, 9.0, 4.0)], "rel_id int, volume double, energy double")
    got = lambda m, **k: [round(r.alpha, 6) for r in Z.relation_weights(e, m, **k).orderBy("rel_id").collect()]
    assert got("inverse_energy") == [0.727273, 0.272727]  # 2 / 1 and 3 / 4
    assert got("feature_smoothness") == got("inverse_energy")
    assert got("inverse_energy_clipped") == [0.647059, 0.352941]  # 0.5 and 0.2727 of 0.7727
    assert got("inverse_sqrt") == [0.571429, 0.428571]  # 2 / 1 and 3 / 2
    assert got("capped_inverse_sqrt") == [0.571429, 0.428571]
    assert got("capped_inverse_sqrt", high=0.5) == [0.538462, 0.461538]
    assert got("smoothed") == [0.727273, 0.272727]
    assert got("smoothed", mix=0.5) == [0.613636, 0.386364]
    assert got("smoothed", temperature=2.0) == [0.620204, 0.379796]  # roots of 2 and 0.75
    assert got("volume") == [0.4, 0.6] and got("uniform") == [0.5, 0.5]
    zero = spark.createDataFrame([(0, 0.0, 1.0), (1, 0.0, 4.0)], e.schema)
    assert [r.alpha for r in Z.relation_weights(zero, "volume", eps=0.0).collect()] == [0.5, 0.5]
    with pytest.raises(ValueError):
        Z.relation_weights(e, "other")


def test_budgets():
    assert P.allocate({0: 5, 1: 95}, 60, {0: 1, 1: 1}, {0: 1.0, 1: 1.0}) == {0: 5, 1: 55}
    assert P.allocate({0: 30, 1: 60, 2: 10}, 20, {0: 1, 1: 1, 2: 1}, {0: 30.0, 1: 60.0, 2: 10.0}) == {0: 6, 1: 11, 2: 3}
    assert P.allocate({0: 3, 1: 3}, 100, {}, {}) == {0: 3, 1: 3}
    with pytest.raises(ValueError):
        P.allocate({0: 5, 1: 5}, 4, {0: 3, 1: 3}, {})
    assert P.stable_budgets({0: 1000, 1: 10, 2: 0}, 101) == {0: 99, 1: 2, 2: 0}
    assert P.pair_weights({0: 30, 1: 10, 2: 5}, {0: "a", 1: "a", 2: "b"}, {"a": 0.8, "b": 0.2}) == pytest.approx({0: 0.6, 1: 0.2, 2: 0.2})


def test_quota_counts():
    def naive(counts, budget, weight):
        plan = {r: 1 if m else 0 for r, m in counts.items()}
        left = max(len(counts), min(sum(counts.values()), round(sum(counts.values()) * budget))) - sum(plan.values())
        while left > 0:
            open_ = [r for r in counts if plan[r] < counts[r]]
            if not open_:
                break
            r = max(open_, key=lambda r: (weight.get(r, 0.05) * (counts[r] - plan[r]), -r))
            plan[r] += 1
            left -= 1
        return plan

    rng = random.Random(3)
    for _ in range(50):
        counts = {r: rng.randint(0, 400) for r in range(5)}
        weight = {r: rng.choice([0.34, 0.16, 0.02]) for r in range(4)}
        budget = rng.random()
        assert sum(P.quota_counts(counts, budget, weight).values()) == sum(naive(counts, budget, weight).values())
        a, b = P.quota_counts(counts, budget, weight), naive(counts, budget, weight)
        assert all(abs(a[r] - b[r]) <= 1 for r in counts)


def test_specs():
    names = {"AB": 0, "BA": 1, "BC": 2}
    assert P.parse_spec("ABBA30-BC05", names) == {0: 0.3, 1: 0.3, 2: 0.05}
    assert P.parse_spec("AB50", names) == {0: 0.5, 1: 1.0, 2: 1.0}
    with pytest.raises(ValueError):
        P.parse_spec("XY10", names)


def test_edge_scores(spark, papers):
    known = papers.nodes.where("node_id = 0").select("node_id")
    got = {(r.rel_id, r.src, r.dst): r.score for r in P.edge_scores(papers.edges, papers.relations, "path_aware", known=known, feature_types=(0, 1), bonus={0: 0.5}, strong=(0,)).collect()}
    tie = lambda s, d: ((s * 1000003) ^ (d * 9176)) % 997 * 1e-9
    # degree 1 / sqrt(1 * 2), at the target, one end known, bonus of the relation, both types have features
    assert got[0, 0, 4] == pytest.approx(1 / math.sqrt(2) + 1 + 0.8 + 0.5 + 0.2 + tie(0, 4), abs=1e-12)
    assert got[0, 1, 4] == pytest.approx(1 / math.sqrt(2) + 1 + 0.2 + tie(1, 4), abs=1e-12)
    assert got[2, 4, 6] == pytest.approx(1.0 + tie(4, 6), abs=1e-12)
    v2 = {(r.rel_id, r.src, r.dst): r.score for r in P.edge_scores(papers.edges, papers.relations, "path_aware_v2", known=known, feature_types=(0, 1)).collect()}
    assert v2[0, 0, 4] == pytest.approx(1 + 1 + 1 + 1 - 0.25 * math.sqrt(2) / 8 - 0.10 * 3 / 16)
    assert v2[2, 4, 6] == pytest.approx(0 + 1 + 0 + 1 - 0.25 / 8 - 0.10 * 2 / 16)
    current = {(r.rel_id, r.src, r.dst): r.score for r in P.edge_scores(papers.edges, papers.relations, "current").collect()}
    assert current[0, 0, 4] == 1 + 0.25 + 0.125 and current[2, 4, 6] == 0.5


def test_boundary_uses_weights(spark):
    g = graph(spark, [(0, 0, -1, 0), (1, 0, -1, 1), (2, 0, -1, 0), (3, 0, -1, 0)], [(0, 0, 1, 3.0), (0, 2, 3, 0.5)], [(0, "r", 0, 0)])
    risk = {r.node_id: r.risk for r in S.boundary_risk(g.edges, g.nodes).collect()}
    assert risk[0] == pytest.approx(1 + 0.05 * math.log(4)) and risk[2] == pytest.approx(0.05 * math.log(1.5) + 1)


def test_normalisation_falls_back(spark):
    df = spark.createDataFrame([(k, k + 1, 0.0 if k < 99 else 5.0) for k in range(100)], "i long, j long, t double")
    assert S.normalize(df, "t", "p95").agg(F.max("t")).first()[0] == pytest.approx(1.0)
    assert S.normalize(df, "t", "median_mad").agg(F.max("t")).first()[0] == pytest.approx(1.0)
    none = df.withColumn("t", F.lit(0.0))
    assert S.normalize(none, "t").agg(F.max("t")).first()[0] == 0


def test_guards(spark):
    pairs = [(0, k, 0, "bucket", float(k), 1.0) for k in range(1, 11)] + [(20, 21, 0, "onehop", 50.0, 1.0), (20, 22, 0, "onehop", 60.0, 1.0), (20, 23, 0, "onehop", 70.0, 1.0)]
    df = spark.createDataFrame(pairs, "i long, j long, type_id int, source string, spec double, cost double")
    kept = {(r.i, r.j) for r in S.spectral_guard(df, keep_per_node=2).collect()}
    # node 20 has nothing below the threshold: its two best stay, and those of 21, 22 and 23
    assert (20, 21) in kept and (20, 22) in kept and (20, 23) in kept
    assert {p for p in kept if p[0] == 20} == {(20, 21), (20, 22), (20, 23)}
    assert not [r for r in S.spectral_guard(df, keep_per_node=0).collect() if r.i == 20]
    assert S.spectral_guard(df, downrank=True).where("i = 20 AND j = 21").first().cost == pytest.approx(1 + 50 - 9.55)
    source = {(r.i, r.j) for r in S.source_guard(df, share=0.1).collect()}
    assert source == {(0, k) for k in range(1, 11)}
    assert S.source_guard(df, share=0.9).count() == 13
    with pytest.raises(Exception, match="(?i)conv"):
        S.cost(df).collect()


def test_one_pass_terms_equal_single_ones(spark, papers):
    x = L.probe(papers.nodes, 3, 1)
    e = L.normalized(papers.edges)
    c = L.fused(e, x, {r: 0.25 for r in range(4)})
    pairs = spark.createDataFrame([(0, 1), (2, 3), (4, 5), (6, 7)], "i long, j long")
    t = {(r.i, r.j): r for r in S.pair_terms(pairs, S.node_table(papers.nodes, papers.edges, [0, 1, 2, 3], papers.features, x, c)).collect()}
    spec = {(r.i, r.j): r.spec for r in S.spectral_cost(pairs, x, L.incident_mass(papers.edges)).collect()}
    rel = {(r.i, r.j): r.rel for r in S.profile_distance(pairs, S.relation_profiles(papers.edges)).collect()}
    feat = {(r.i, r.j): r.feat for r in S.feature_distance(pairs, papers.features).collect()}
    risk = {(r.i, r.j): r.boundary for r in S.boundary_cost(pairs, S.boundary_risk(papers.edges, papers.nodes), papers.nodes).collect()}
    for k in t:
        assert (t[k].spec, t[k].rel, t[k].feat, t[k].boundary) == pytest.approx((spec[k], rel[k], feat[k], risk[k]))


def test_ranks_and_neighbours(spark):
    rng = random.Random(5)
    data = [(k, rng.randrange(3), rng.choice([1.0, 2.0, 2.0, 2.0, 3.5, -4.0, 1e9])) for k in range(500)]
    df = spark.createDataFrame(data, "node_id long, g int, v double")
    for down in (False, True):
        want = []
        for g in range(3):
            own = sorted(((-v if down else v), k) for k, h, v in data if h == g)
            want += [(k, r + 1) for r, (_, k) in enumerate(own)]
        assert rows(ranked(df, ["g"], ["v", "node_id"], 7, down).select("node_id", "rank")) == sorted(want)
    near = rows(neighbours(df, ["g"], ["v", "node_id"], 2).select("i", "j"))
    want = []
    for g in range(3):
        own = [k for _, k in sorted((v, k) for k, h, v in data if h == g)]
        want += [(own[a], own[b]) for a in range(len(own)) for b in (a + 1, a + 2) if b < len(own)]
    assert near == sorted(want)


def test_diverse_select(spark):
    rng = random.Random(9)
    for trial in range(4):
        data = [(k, rng.randrange(-1, 4), rng.randrange(-1, 3), round(rng.random(), 2)) for k in range(60)]
        df = spark.createDataFrame(data, "node_id long, class_block int, anchor_block int, importance double")
        used_c, used_a, left, picks = set(), set(), list(data), []
        while left and len(picks) < 25:

            def value(r):
                s = r[3]
                s += 0 if r[1] < 0 else -0.03 if r[1] in used_c else 0.15
                s += 0 if r[2] < 0 else -0.02 if r[2] in used_a else 0.10
                return round(s, 9), -r[0]

            best = max(left, key=value)
            picks.append(best[0])
            left.remove(best)
            used_c |= {best[1]} - {-1}
            used_a |= {best[2]} - {-1}
        got = [r.node_id for r in N.diverse_select(df, 25).orderBy("place").collect()]
        assert got == picks, trial


def scan(pairs, cap, guard=(), labels=None):
    up, size, keep, safe = {}, {}, [], set(guard)

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for c, i, j in sorted((c, i, j) for i, j, c in pairs):
        if labels and labels[i] >= 0 and labels[j] >= 0 and labels[i] != labels[j]:
            continue
        a, b = root(i), root(j)
        n = size.get(a, 1) + size.get(b, 1)
        if a != b and n <= (2 if a in safe or b in safe else cap):
            up[max(a, b)] = min(a, b)
            size[min(a, b)] = n
            safe |= {min(a, b)} if a in safe or b in safe else set()
            keep.append((i, j, c))
    return sorted(keep)


def test_guarded_clusters(spark):
    rng = random.Random(2)
    for _ in range(3):
        labels = {k: rng.randrange(-1, 2) for k in range(40)}
        guard = {k for k in range(40) if rng.random() < 0.2}
        pairs = sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(150)) if a != b})
        pairs = [(i, j, rng.randrange(5) / 4) for i, j in pairs]
        df = spark.createDataFrame([(i, j, c, 0, i in guard, j in guard, labels[i], labels[j]) for i, j, c in pairs], "i long, j long, cost double, g int, guard_i boolean, guard_j boolean, label_i int, label_j int")
        assert rows(M.greedy_cluster(df, ["g"], 4)) == scan(pairs, 4, guard, labels)
        assert rows(M.greedy_cluster(df.select("i", "j", "cost", "g"), ["g"], 3)) == scan(pairs, 3)


def test_coverage_sample(spark):
    rng = random.Random(7)
    edges = sorted({(0, rng.randrange(12), 100 + rng.randrange(12)) for _ in range(90)})
    scored = [(r, s, d, 1.0, rng.randrange(20) / 20) for r, s, d in edges]
    df = spark.createDataFrame(scored, "rel_id int, src long, dst long, w double, score double")
    for budget, cap in ((20, 2), (50, 2), (10, 5)):
        order = sorted(scored, key=lambda e: (-e[4], e[1], e[2]))
        a, b, first = {}, {}, []
        for e in order:
            if len(first) < budget and a.get(e[1], 0) < cap and b.get(e[2], 0) < cap:
                first.append(e)
                a[e[1]] = a.get(e[1], 0) + 1
                b[e[2]] = b.get(e[2], 0) + 1
        rescue = [e for e in order if e not in first][: budget - len(first)]
        plan = P.plan_table(df, [(0, len(scored), budget)])
        got = P.coverage_sample(df, plan, cap)
        assert rows(got.select("src", "dst", "rescued")) == sorted([(e[1], e[2], False) for e in first] + [(e[1], e[2], True) for e in rescue])


def test_units_under_budget(spark):
    rng = random.Random(4)
    for ratio in (0.1, 0.33, 0.7):
        units = [(f"u{k:02}", "s", rng.randint(1, 6), round(rng.random(), 1)) for k in range(40)]
        df = spark.createDataFrame(units, "unit string, source string, members long, score double")
        total, left, want = sum(u[2] for u in units), 0, []
        left = math.ceil(total * ratio - 1e-12)
        for u in sorted(units, key=lambda u: (-u[3], -u[2], u[1], u[0])):
            if u[2] <= left:
                want.append(u[0])
                left -= u[2]
        assert sorted(r.unit for r in N.under_budget(df, total, ratio).collect()) == sorted(want)


def test_clusters_by_gain(spark):
    units = [("a", 3, 0.5), ("b", 2, 0.5), ("c", 4, 0.00005), ("d", 1, -0.0003), ("e", 9, -0.1)]
    df = spark.createDataFrame(units, "unit string, members long, gain double")
    got = N.select_clusters(df, 19, 0.5)  # ten members wanted
    assert rows(got) == [("a", 3, "positive"), ("b", 2, "positive"), ("c", 4, "neutral"), ("d", 1, "negative")]
    r = N.selection_report(got, 19, 0.5).first()
    assert (r.members, r.positive, r.neutral, r.negative) == (10, 2, 1, 1) and r.overfill == pytest.approx(10 / 19 - 0.5)


def test_quota_matching(spark):
    pairs = [(0, 1, 0.1, "onehop"), (2, 3, 0.2, "onehop"), (4, 5, 0.3, "onehop"), (6, 7, 0.4, "bucket"), (0, 2, 0.5, "bucket"), (8, 9, 0.6, "bucket")]
    df = spark.createDataFrame(pairs, "i long, j long, cost double, source string")
    got = rows(M.quota_matching(df, 4, 0.5, {"onehop": 0.25}).select("i", "j", "source"))
    assert got == [(0, 2, "bucket"), (4, 5, "onehop"), (6, 7, "bucket"), (8, 9, "bucket")]
    assert rows(M.source_distribution(M.quota_matching(df, 2))) == [("onehop", 2, 1.0)]


def test_repair(spark):
    nodes = spark.createDataFrame([(k, 0, -1, 0) for k in range(8)], "node_id long, type_id int, label int, part_id int")
    x = spark.createDataFrame([(k, v) for k, v in enumerate([0.0, 5.0, 0.1, 5.1, 1.0, 1.0, 1.0, 1.1])], "node_id long, v0 double")
    a = spark.createDataFrame([(k, 0 if k < 4 else 4) for k in range(8)], "node_id long, super_id long")
    got = {r.node_id: r.super_id for r in M.repair_clusters(a, x, nodes).collect()}
    assert got == {0: 0, 2: 0, 1: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4}


def test_paths_and_budget_rules(papers):
    specs = papers.relations.collect()
    found = H.schema_paths(specs, 0, (2,), 3)
    assert [p[3] for p in found][0] == [0, 1] and all(len(p[3]) == 2 for p in found)
    assert Z.closed_paths(specs, 2)[0][2] == [(0, "forward"), (0, "backward")]
    assert N.target_paths(specs, 0, 2) == [(), (1,), (0, 1), (3, 1)]
    b = R.support_budget(10, 4, support_ratio=0.5)
    assert (b["max_merges"], b["desired_total_nodes"]) == (3, 7)
    assert R.support_budget(10, 4, target_ratio=0.3)["infeasible"] and R.support_budget(10, 4, merges=99)["max_merges"] == 6
    assert R.support_budget(10, 4)["max_merges"] is None
    assert R.stop_reason(3, 3, 1, 1, 1, 1) == "reached_requested_support_ratio" and R.stop_reason(5, 3, 2, 4, 0, 0) == "constraint_blocked_all_candidates"
    assert H.mass_evidence([("a", 0.1), ("z", 0.5)], {"a"}, {"z"}) == "secondary_main" and H.mass_evidence([], {"a"}, {"z"}) == "not_supported"
    assert K.anchor_budget(100, 20, 500, 0.3) == 30 and K.anchor_budget(100, 20, 500, 0.3, False) == 75


def test_identity_has_no_error(spark, papers):
    same = papers.nodes.select("node_id", F.col("node_id").alias("super_id"))
    x = L.probe(papers.nodes, 2)
    row = G.spectral_report(papers, papers.edges, same, x, {r: 0.25 for r in range(4)}).first()
    assert all(abs(v) < 1e-9 for v in row)
    seed = R.seeds(papers.nodes, papers.nodes.where("type_id = 0").select("node_id", "label"), 2)
    assert R.response_error(papers, same, seed, 0, [0, 1, 2, 3]) < 1e-12
    assert all(e < 1e-12 for e in R.relation_response_errors(papers, same, seed, 0).values())
    s = H.path_survival(H.sample_paths(papers, [0, 2], 10), [0, 2], papers, papers.edges, same)
    assert all(r.typed == 1 and r.before == r.after == 1 and r.log_count_error == 0 for r in s.collect())
    inv = G.level_invariants(papers, papers, same).first()
    assert all(v == 0 for v in inv)
    assert min(G.eigenvalues(papers, {r: 0.25 for r in range(4)})) > -1e-9


def test_anchors_one_by_one(spark, papers):
    rng = random.Random(1)
    nodes = [(k, 0, rng.randrange(-1, 3), 0) for k in range(15)] + [(100 + k, 1, -1, 0) for k in range(8)]
    edges = sorted({(0, rng.randrange(15), 100 + rng.randrange(8)) for _ in range(40)})
    g = graph(spark, nodes, [(*e, 1.0) for e in edges], [(0, "r", 0, 1)])
    train = g.nodes.where("node_id IN (2, 9)")
    got = sorted(r.node_id for r in K.select_anchors(g.nodes, g.edges, g.relations, 0, train, 7).collect())
    cover = {k: {d for _, s, d in edges if s == k} for k in range(15)}
    top = max(len(c) for c in cover.values())
    conf = {k: len(cover[k]) / max(top, 1) for k in cover}
    label = {k: lab for k, t, lab, _ in nodes if t == 0}
    classes = max(2, max(label.values())) + 1
    cls = {k: label[k] if label[k] >= 0 else k % classes for k in label}
    picks = [2, 9]
    most = max(len(cover[k]) for k in cover if k not in picks)
    while len(picks) < 7:
        covered = set().union(*(cover[k] for k in picks))

        def value(k):
            near = min(abs(k - p) for p in picks) / 14
            s = 0.35 * conf[k] + 0.10 * (1 - abs(conf[k] - 0.5) * 2) + 0.25 * len(cover[k] - covered) / most + 0.20 * near + 0.10 / (1 + sum(cls[p] == cls[k] for p in picks))
            return round(s, 9), -k

        picks.append(max((k for k in cover if k not in picks), key=value))
    assert got == sorted(picks)


def test_gini_and_curves(spark):
    df = spark.createDataFrame([(0, x) for x in (1, 1, 1, 7)], "g int, d long")
    assert P.gini(df, ["g"], "d").first().gini == pytest.approx(2 * (1 + 2 + 3 + 4 * 7) / (4 * 10) - 5 / 4)
    points = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (3.0, 0.5)], "x double, y double")
    r = K.curve_summary(points).first()
    assert (r.best, r.best_x) == (1.0, 1.0) and r.area == pytest.approx((0.5 + 1.5) / 3)


def test_condensed_graph(papers, spark):
    keys = papers.nodes.where("type_id != 0").select("node_id", "type_id")
    g, a = N.condensed(papers, 0, spark.createDataFrame([(6,)], "node_id long"), keys, cap=2)
    assert {r.node_id: r.super_id for r in a.collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}
    assert g.edges.agg(F.sum("w")).first()[0] == papers.edges.agg(F.sum("w")).first()[0]
    g, a = N.condensed(papers, 0, spark.createDataFrame([(6,)], "node_id long"), keys, background="type")
    assert a.select("super_id").distinct().count() == 4 + 1 + 1 + 1
